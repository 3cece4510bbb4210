"""Encoders: the built-in hashing encoder and the slot for a user-supplied model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.vectors import hash_buckets

#: Words whose buckets a task keeps.
KNOWN = 100_000
#: Rows that are counted at a time.
ROWS = 1_024


@dataclass(frozen=True)
class Encoder:
    """A model as data: a name, its size, role prefixes, and a loader called once per worker.

    `load()` returns a callable texts → (dense rows, list of sparse weight dicts or None).
    """

    name: str
    dimensions: int
    load: Callable[[], Callable[[list[str]], tuple[np.ndarray, list[dict[str, float]] | None]]]
    query_prefix: str = ""
    passage_prefix: str = ""


def hashing_encode(df: DataFrame, key: str, text: str, buckets: int = K.HASH_BUCKETS) -> DataFrame:
    """(key, bucket, weight): word counts per hash bucket, L2-normalised, stored sparsely.

    All rows of a key come from one input row; repartitioning by the key once lets both
    aggregations run without a further exchange.
    """
    counts = (
        df.select(key, hash_buckets(F.col(text), buckets).alias("_b"))
        .repartition(key)
        .select(key, F.explode("_b").alias("bucket"))
        .groupBy(key, "bucket")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def hashing_dense(df: DataFrame, key: str, text: str, buckets: int = K.HASH_BUCKETS) -> DataFrame:
    """(key, embedding): the same vectors as dense arrays; texts without words give zeros.

    In Arrow batches texts are cut at white space, each distinct word is hashed once, and one count fills all rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), dense_lists(part.column(1), buckets, known)], names=[key, "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.lower(F.col(text)).alias("_w")).mapInArrow(count, f"{key} {kind}, embedding array<double>")


def dense_lists(texts: pa.Array, buckets: int, known: dict[str, int]) -> pa.ListArray:
    """The vectors of lower-cased texts."""
    dense = unit_rows(bucket_counts(pc.ascii_split_whitespace(texts), buckets, known))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(dense) + 1, dtype=np.int32) * buckets), pa.array(dense.ravel()))


def bucket_counts(lists: pa.ListArray, buckets: int, known: dict[str, int]) -> np.ndarray:
    """Words per hash bucket, one row a list; `known` keeps the buckets of words between calls. Empty words do not count."""
    listed = lists.flatten().dictionary_encode()
    if len(known) > KNOWN:
        known.clear()
    at = np.array([known[w] if w in known else known.setdefault(w, _bucket(w, buckets)) for w in listed.dictionary.to_pylist()], np.int64)
    sizes = np.diff(np.asarray(lists.offsets)) * lists.is_valid().to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(len(sizes)) * buckets, sizes) + (at[listed.indices.to_numpy()] if len(at) else 0)
    if pc.any(pc.equal(listed.dictionary, "")).as_py():
        place = place[pc.not_equal(listed.dictionary, "").to_numpy(zero_copy_only=False)[listed.indices.to_numpy()]]
    return np.bincount(place.astype(np.int64), minlength=len(sizes) * buckets).reshape(-1, buckets).astype(np.float64)


def _bucket(word: str, buckets: int) -> int:
    """As `bucket` of the search words: the first 32 bits of the word's MD5."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % buckets


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


_loaded: dict[str, Callable] = {}


def encode(df: DataFrame, key: str, text: str, encoder: Encoder, role: str = "passage") -> DataFrame:
    """(key, embedding, weights) from a pluggable model, normalised, zero vectors kept."""
    prefix = encoder.query_prefix if role == "query" else encoder.passage_prefix

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if encoder.name not in _loaded:
            _loaded[encoder.name] = encoder.load()
        model = _loaded[encoder.name]
        for batch in batches:
            dense, sparse = model([prefix + (t or "") for t in batch[text]])
            dense = unit_rows(np.asarray(dense, dtype=np.float64))
            yield pd.DataFrame(
                {
                    key: batch[key],
                    "embedding": list(dense),
                    "weights": sparse if sparse is not None else [None] * len(batch),
                }
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(
        run, f"{key} {kind}, embedding array<double>, weights map<string,double>"
    )
