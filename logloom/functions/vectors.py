"""Vector similarity and keyword overlap as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weights of the hybrid score
VECTOR_WEIGHT = 0.8
KEYWORD_WEIGHT = 0.2
PLACEHOLDERS = ["uuid", "ip", "hex", "num"]


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(_dot(vector, vector))


def cosine(left: Column, right: Column, left_norm: Column | None = None, right_norm: Column | None = None) -> Column:
    """Cosine similarity; NULL where either vector is zero or NULL. Norms that are known already may be given."""
    lengths = [norm(v) if n is None else n for v, n in ((left, left_norm), (right, right_norm))]
    return F.try_divide(_dot(left, right), lengths[0] * lengths[1])


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, template masks left out."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(t) for t in ["", *PLACEHOLDERS]]))


def covers(words: Column, wanted: Column) -> Column:
    """True where `words` has all of `wanted`; no words never match."""
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, words)) == 0)


def has_all_tokens(text: Column, query: Column) -> Column:
    """True where every word of the query occurs in the text; no words never match."""
    return covers(tokens(text), tokens(query))


def hybrid_score(similarity: Column, keyword_match: Column) -> Column:
    return F.lit(VECTOR_WEIGHT) * similarity + F.lit(KEYWORD_WEIGHT) * F.when(
        keyword_match, F.lit(1.0)
    ).otherwise(F.lit(0.0))
