"""Purpose finder: sentences of a description against a catalogue of purpose lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta import constants as K
from statuta.functions.text import let, sentences, settled
from statuta.functions.vectors import blank_words
from statuta.operators.encode import ROWS, bucket_counts
from statuta.operators.rescore import loaded
from statuta.session import cut_lineage


@dataclass(frozen=True)
class PurposeLine:
    id: int
    text: str
    key: str
    klass: str
    rule: str
    counter: bool = False
    required: tuple[str, ...] = ()


def confidence_band(value: Column) -> Column:
    return (
        F.when(value >= 0.90, "sicher").when(value >= 0.70, "wahrscheinlich").otherwise("zu prüfen")
    )


def sentence_table(descriptions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence_no, sentence)."""
    # settled: the explode would else copy all rules of the sentences into a filter above the scan
    split = descriptions.select(key, settled(sentences(F.col(text))).alias("_s"))
    return split.select(key, F.posexplode("_s").alias("sentence_no", "sentence"))


def purpose_vectors(lines: tuple[PurposeLine, ...], buckets: int = K.HASH_BUCKETS) -> list[list[float]]:
    """Hashing vectors of the catalogue, computed once on the driver (a few hundred short lines)."""
    import hashlib
    import math

    out = []
    for line in lines:
        row = [0.0] * buckets
        for word in line.text.lower().split():
            row[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % buckets] += 1.0
        norm = math.sqrt(sum(x * x for x in row))
        out.append([x / norm if norm else 0.0 for x in row])
    return out


def candidate_pairs(
    rows: DataFrame, lines: tuple[PurposeLine, ...], key: str, buckets: int = K.HASH_BUCKETS
) -> DataFrame:
    """(key, sentence_no, sentence, line_id, similarity): what a costly scorer has to look at.

    Per sentence the lines are walked by similarity; at most 2 keys of a rule and 5 keys in all are
    taken, then all lines of these keys, counter lines included. The sentences of an Arrow batch are
    walked together, so no pair that was not chosen ever becomes a row and nothing is shuffled.
    """
    lines = tuple(sorted(lines, key=lambda line: (line.id, line.key, line.rule)))
    vectors = np.array(purpose_vectors(lines, buckets)).reshape(-1, buckets).T
    ids = np.array([line.id for line in lines], np.int32)
    keys = np.unique([line.key for line in lines], return_inverse=True)[1]
    rules = np.unique([line.rule for line in lines], return_inverse=True)[1]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts = bucket_counts(part.column(3), buckets, known)
                norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                # einsum: products this small are not worth the threads of a matrix library in every task
                like = np.einsum("ij,jk->ik", counts, vectors)
                like = np.round(np.divide(like, norm, out=np.zeros_like(like), where=norm > 0), 9)
                order = np.argsort(-like, axis=1, kind="stable")
                chosen = np.take_along_axis(_taken(order, keys, rules), keys[order], axis=1)
                ends = np.r_[0, np.cumsum(chosen.sum(axis=1))].astype(np.int32)
                pairs = pa.StructArray.from_arrays(
                    [pa.array(ids[order][chosen]), pa.array(np.take_along_axis(like, order, axis=1)[chosen])], names=["line_id", "similarity"]
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pairs)], names=[key, "sentence_no", "sentence", "pairs"]
                )

    if not lines:
        return rows.select(key, "sentence_no", "sentence", F.lit(0).alias("line_id"), F.lit(0.0).alias("similarity")).limit(0)
    kind = rows.schema[key].dataType.simpleString()
    chosen = rows.select(key, "sentence_no", "sentence", blank_words(F.col("sentence")).alias("_w")).mapInArrow(
        choose, f"`{key}` {kind}, sentence_no INT, sentence STRING, pairs ARRAY<STRUCT<line_id: INT, similarity: DOUBLE>>"
    )
    return chosen.select(key, "sentence_no", "sentence", F.inline("pairs"))


def _taken(order: np.ndarray, keys: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Which keys each row takes when it walks its lines in the given order."""
    row = np.arange(len(order))
    taken = np.zeros((len(order), keys.max() + 1), bool)
    used = np.zeros((len(order), rules.max() + 1), np.int64)
    for line in order.T:
        ok = ~taken[row, keys[line]] & (used[row, rules[line]] < K.KEYS_PER_RULE) & (used.sum(axis=1) < K.KEYS_PER_SENTENCE)
        taken[row[ok], keys[line[ok]]] = True
        used[row[ok], rules[line[ok]]] += 1
    return taken


def score_pairs(
    pairs: DataFrame,
    lines: tuple[PurposeLine, ...],
    load: Callable[[], Callable[[list[str], list[str]], list[float]]] | None,
) -> DataFrame:
    """Adds `value` in [0, 1] from a pair scorer (sentences, purposes) → values.

    Without a scorer the similarity of the hashing vectors stands in (documented substitute).
    """
    if load is None:
        return pairs.withColumn("value", F.col("similarity"))
    texts = {line.id: line.text for line in lines}

    def run(sentence: pd.Series, line_id: pd.Series) -> pd.Series:
        scorer = loaded(load)
        return pd.Series(scorer(list(sentence), [texts[i] for i in line_id]))

    return pairs.withColumn(
        "value", F.pandas_udf(run, T.DoubleType())(F.col("sentence"), F.col("line_id"))
    )


def decide(
    pairs: DataFrame,
    lines: tuple[PurposeLine, ...],
    descriptions: DataFrame,
    key: str,
    text: str,
    threshold: float = K.PURPOSE_THRESHOLD,
    top: int = K.PURPOSE_HITS,
) -> DataFrame:
    """(key, unit_key, class, rule, value, purpose, sentence, band, place): the purposes that carry.

    A purpose carries when its value reaches the threshold of its class, beats the best counter line
    of its rule and every strong counter line, and the required wording occurs. No pair below the
    least threshold can carry, and no counter line below it can beat one that does: these pairs stay
    behind, and the few others are written once. Of a text only the required words it holds go on.
    """
    limits = F.lit(threshold)
    for klass, limit in K.PURPOSE_CLASS_THRESHOLD.items():
        limits = F.when(F.col("class") == klass, F.lit(limit)).otherwise(limits)
    least = min(threshold, *K.PURPOSE_CLASS_THRESHOLD.values())
    strongest = pairs.select(key, "sentence_no", "sentence", "line_id", "value").where(F.col("value") >= least)
    named = named_pairs(cut_lineage(strongest, "pairs"), lines)
    best = best_per_key(named.where("NOT counter"), key)
    counters = named.where("counter").groupBy(key, "rule").agg(F.max("value").alias("counter_value"))
    strong = counters.groupBy(key).agg(
        F.max(F.when(F.col("counter_value") >= K.STRONG_COUNTER, F.col("counter_value"))).alias("strong")
    )
    wanted = sorted({w.lower() for line in lines for w in line.required})
    wanted = F.array(*[F.lit(w) for w in wanted]).cast("array<string>")
    holding = let(F.lower(F.col(text)), lambda low: F.filter(wanted, lambda w: F.contains(low, w)))
    worded = descriptions.select(key, holding.alias("_holds"))
    beaten = F.greatest(F.coalesce("counter_value", F.lit(-1.0)), F.coalesce("strong", F.lit(0.0)))
    carried = (
        best.join(counters, [key, "rule"], "left")
        .join(strong, key, "left")
        .where((F.col("value") >= limits) & (F.col("value") > beaten))
    )
    worded = carried.join(worded, key).where((F.size("required") == 0) | F.arrays_overlap("required", "_holds"))
    order = W.partitionBy(key).orderBy(F.desc("value"), "unit_key")
    return (
        worded.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
        .select(
            key,
            "unit_key",
            "class",
            "rule",
            F.round("value", 4).alias("value"),
            "purpose",
            "sentence",
            confidence_band(F.round("value", 4)).alias("band"),
            "place",
        )
    )


def named_pairs(pairs: DataFrame, lines: tuple[PurposeLine, ...]) -> DataFrame:
    """The pairs with what the catalogue says of their line."""
    catalogue = pairs.sparkSession.createDataFrame(
        [(p.id, p.text, p.key, p.klass, p.rule, p.counter, [w.lower() for w in p.required]) for p in lines],
        "line_id int, purpose string, unit_key string, class string, rule string, counter boolean, "
        "required array<string>",
    )
    return pairs.join(F.broadcast(catalogue), "line_id")


def best_purposes(pairs: DataFrame, lines: tuple[PurposeLine, ...], key: str) -> DataFrame:
    """Best line per (description, unit key) of scored pairs (key, sentence_no, sentence, line_id, value).

    The pairs of a description stand together where they were made. Of each Arrow batch only the best pair
    of a description and unit key goes on, so what is exchanged grows with the result and not with the pairs.
    """
    own = sorted((line for line in lines if not line.counter), key=lambda line: line.id)
    ids = np.array([line.id for line in own], np.int64)
    keys = np.unique([line.key for line in own], return_inverse=True)[1]

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(4).to_numpy(zero_copy_only=False)
            if np.isnan(value).any():  # a scorer's nulls and the like: left to the aggregate
                yield batch
                continue
            described = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            sentence, line = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
            at = keys[np.searchsorted(ids, line)]
            order = np.lexsort((line, sentence, -value, at, described))
            group = described[order].astype(np.int64) * len(ids) + at[order]
            yield batch.take(pa.array(order[np.r_[True, group[1:] != group[:-1]]]))

    rows = pairs.select(key, "sentence_no", "sentence", "line_id", "value").where(F.col("line_id").isin(ids.tolist()))
    return best_per_key(named_pairs(rows.mapInArrow(reduced, rows.schema), lines), key)


def best_per_key(named: DataFrame, key: str) -> DataFrame:
    """Best line per (description, unit key); ties go to the earlier sentence, then line."""
    order = F.struct(F.col("value"), -F.col("sentence_no"), -F.col("line_id"))
    return (
        named.groupBy(key, "unit_key")
        .agg(
            F.max_by(
                F.struct("class", "rule", "value", "purpose", "sentence", "required"), order
            ).alias("b")
        )
        .select(key, "unit_key", "b.*")
    )


def per_rule(hits: DataFrame, key: str) -> DataFrame:
    """(key, purposes map rule → best hit): the form the classifier reads. At most four entries."""
    best = hits.groupBy(key, "rule").agg(
        F.max_by(
            F.struct("value", F.col("unit_key").alias("key"), "purpose", "sentence"),
            F.struct("value", -F.col("place")),
        ).alias("hit")
    )
    return best.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "hit"))).alias("purposes")
    )
