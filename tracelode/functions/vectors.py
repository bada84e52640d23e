"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length 1; one of length 0 stays as it is, so its cosine with anything is 0."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0)))


def unit_tokens(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: unit(doubles(t)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def max_sim(query: Column, candidate: Column) -> Column:
    """Sum over the query's tokens of the largest dot product with a token of the candidate; cosine if both are at unit length."""
    best = F.transform(query, lambda x: F.array_max(F.transform(candidate, lambda y: dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def cls(tokens: Column) -> Column:
    return F.element_at(tokens, 1)


def pooled(tokens: Column, how: str) -> Column:
    """`all` keeps the token matrix, `cls` its first row, `mean` the mean of its rows, each as a matrix."""
    if how == "all":
        return tokens
    if how == "cls":
        return F.slice(tokens, 1, 1)
    if how == "mean":
        total = F.aggregate(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(1))), doubles(F.element_at(tokens, 1)), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
        return F.array(F.transform(total, lambda x: x / F.size(tokens)))
    raise ValueError(f"no such pooling: {how}")
