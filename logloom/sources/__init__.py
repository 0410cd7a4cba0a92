"""Reading, writing and laying out the tables the operators work on."""
