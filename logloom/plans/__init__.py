"""Request documents (JSON query form) and the catalogue of registered queries."""
