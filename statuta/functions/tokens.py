"""Search words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.text import fold_ascii, let


def words(c: Column, folded: bool = False) -> Column:
    """Words of ≥2 characters without stop words, plus the parts (>2) of hyphen compounds again."""
    return _words(c) if folded else let(fold_ascii(c), _words)


def _words(flat: Column) -> Column:
    plain = F.filter(
        F.regexp_extract_all(flat, F.lit("[a-z0-9]+"), F.lit(0)),
        lambda w: (F.length(w) >= 2) & ~w.isin(*K.STOP_WORDS),
    )
    compounds = F.regexp_extract_all(flat, F.lit("[a-z]+(?:-[a-z]+)+"), F.lit(0))
    parts = F.filter(
        F.flatten(F.transform(compounds, lambda w: F.split(w, "-"))),
        lambda w: (F.length(w) > 2) & ~w.isin(*K.STOP_WORDS),
    )
    return F.when(F.contains(flat, F.lit("-")), F.concat(plain, parts)).otherwise(plain)


def bucket(word: Column, buckets: int = K.HASH_BUCKETS) -> Column:
    """Stable hash bucket of a word (first 32 bits of its MD5)."""
    return (
        F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets
    ).cast("int")


def fraction(*parts: Column) -> Column:
    """Reproducible number in [0, 1) from the MD5 of the joined parts."""
    joined = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
