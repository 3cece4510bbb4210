"""Dense and sparse vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.tokens import bucket


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of numbers in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + F.coalesce(x, F.lit(0.0)),
    )


def normalise(v: Column) -> Column:
    """L2 norm 1; a zero vector stays zero."""
    norm = F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def blank_words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0)


def hash_buckets(text: Column, buckets: int = K.HASH_BUCKETS) -> Column:
    """Hash bucket of every word of a text, repetitions kept."""
    return F.transform(blank_words(text), lambda w: bucket(w, buckets))
