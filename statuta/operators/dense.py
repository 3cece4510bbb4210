"""Brute-force dense similarity for a batch of queries."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.operators.bm25 import SCORE_DIGITS, top_per_query

QUERY_BLOCK = 1_024
UNIT_BLOCK = 8_192
#: Queries up to which every task gets them all; the units then stay where they are.
PASSED = 4_096
#: Units that are multiplied at a time where they pass by.
PART = 4_096
#: Blocks of units a slot holds, about.
SLOT_BLOCKS = 4


def dense_search(
    units: DataFrame,
    queries: DataFrame,
    k: int = K.PER_WAY,
    block: int = QUERY_BLOCK,
    unit_block: int = UNIT_BLOCK,
) -> DataFrame:
    """Top-k units per query by dot product (cosine, as vectors are normalised).

    Up to `PASSED` queries go to the tasks that read the units, which pass by in parts and leave k rows a
    query and task; no vector of a unit is exchanged. Beyond, vectors travel in blocks, each once: a block of
    units goes to a slot, of which there are as many as the units fill, and every slot gets a copy of each block
    of queries. In a slot the units come first and stay, then the blocks of queries pass by; pairs of blocks are
    never rows. A slot hands on k rows a query.
    A first product in single precision leaves the units that can be among the k best, within its rounding
    error; these are multiplied again in double precision.
    """
    q_type = queries.schema["query_id"].dataType.simpleString()
    few = queries.select("query_id", "embedding").limit(PASSED + 1).toArrow()
    if few.num_rows <= PASSED:
        return top_per_query(_passing(units.select("unit_key", "embedding"), few, q_type, k), k)
    slots = max(1, math.ceil(units.count() / (unit_block * SLOT_BLOCKS)))
    u_type = units.schema["unit_key"].dataType.simpleString()
    own = _blocks(units.select("unit_key", "embedding"), u_type, unit_block).select(
        F.pmod(F.xxhash64("keys"), F.lit(slots)).cast("int").alias("slot"),
        F.lit(0).alias("side"),
        F.col("keys").alias("unit_keys"),
        F.lit(None).cast(f"array<{q_type}>").alias("query_keys"),
        "rows",
    )
    asked = _blocks(queries.select("query_id", "embedding"), q_type, block).select(
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
        F.lit(1).alias("side"),
        F.lit(None).cast(f"array<{u_type}>").alias("unit_keys"),
        F.col("keys").alias("query_keys"),
        "rows",
    )
    met = own.unionByName(asked).repartition(slots, "slot").sortWithinPartitions("slot", "side")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            slot_of, _, units_of, queries_of, rows_of = batch.columns
            kinds = [queries_of.type.value_type, units_of.type.value_type]
            for i in range(batch.num_rows):
                if slot_of[i].as_py() != now:
                    now, held = slot_of[i].as_py(), []
                if units_of[i].is_valid:
                    keys = units_of[i].as_py()
                    held.append((keys, _matrix(rows_of[i], keys)))
                    continue
                asked = queries_of[i].as_py()
                found: list[list[tuple]] = [[] for _ in asked]
                rows = _matrix(rows_of[i], asked)
                for keys, matrix in held:
                    _better(found, keys, matrix, rows, k)
                yield _rows(asked, found, kinds)

    scored = met.mapInArrow(best, f"query_id {q_type}, unit_key {u_type}, score double")
    return top_per_query(scored, k)


def _passing(units: DataFrame, asked: pa.Table, q_type: str, k: int) -> DataFrame:
    """(query_id, unit_key, score): the k best units of each task for every query."""
    u_type = units.schema["unit_key"].dataType.simpleString()
    kind = asked.schema.field("query_id").type
    keys = asked["query_id"].to_pylist()
    rows = _vectors(asked["embedding"].combine_chunks(), len(keys))
    shared = units.sparkSession.sparkContext.broadcast((keys, rows))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        found: list[list[tuple]] = [[] for _ in keys]
        unit_kind = None
        for batch in batches:
            unit_kind = batch.column(0).type
            for at in range(0, batch.num_rows if keys else 0, PART):
                part = batch.slice(at, PART)
                for q in range(0, len(keys), QUERY_BLOCK):
                    held = found[q : q + QUERY_BLOCK]
                    _better(held, part.column(0).to_pylist(), _vectors(part.column(1), part.num_rows), rows[q : q + QUERY_BLOCK], k)
                    found[q : q + QUERY_BLOCK] = held
        if unit_kind is not None:
            yield _rows(keys, found, [kind, unit_kind])

    return units.mapInArrow(best, f"query_id {q_type}, unit_key {u_type}, score double")


def _vectors(lists: pa.Array, n: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _matrix(raw: pa.Scalar, keys: list) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.float64).reshape(len(keys), -1)


def _better(found: list[list[tuple]], keys: list, units: np.ndarray, asked: np.ndarray, k: int) -> None:
    """Adds a block's scores to the k best of each query: score descending, key ascending."""
    norms = np.sqrt(np.einsum("ij,ij->i", units, units)), np.sqrt(np.einsum("ij,ij->i", asked, asked))
    rough = (units.astype(np.float32) @ asked.astype(np.float32).T).astype(np.float64)
    # what single precision and the rounding of scores may be off, twice
    slack = 4 * (units.shape[1] + 4) * np.finfo(np.float32).eps * norms[0].max(initial=0) * norms[1] + 4 * 10.0**-SCORE_DIGITS
    slack = np.where(np.isfinite(rough).all(axis=0), slack, np.inf)
    least = np.partition(rough, -k, axis=0)[-k] if len(keys) > k else np.full(rough.shape[1], -np.inf)
    for q, held in enumerate(found):
        floor = max(least[q], -held[-1][0]) if len(held) == k else least[q]
        at = np.nonzero(~(rough[:, q] < floor - slack[q]))[0]
        if len(at):
            exact = np.round(units[at] @ asked[q], SCORE_DIGITS)
            found[q] = heapq.nsmallest(k, [*held, *((-float(s), keys[i]) for s, i in zip(exact, at))])


def _rows(keys: list, found: list[list[tuple]], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([q for q, held in zip(keys, found) for _ in held], kinds[0]),
            pa.array([unit for held in found for _, unit in held], kinds[1]),
            pa.array([-score for held in found for score, _ in held], pa.float64()),
        ],
        names=["query_id", "unit_key", "score"],
    )


def _blocks(vectors: DataFrame, kind: str, size: int) -> DataFrame:
    """(keys, rows): keys and vectors of a task's rows, at most `size` together."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        rows: list = []

        def block() -> pa.RecordBatch:
            raw = np.concatenate(rows).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(batch.column(0).type)), pa.array([raw], pa.binary())], names=["keys", "rows"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if keys and len(keys) + part.num_rows > size:
                    yield block()
                    keys, rows = [], []
                keys += part.column(0).to_pylist()
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        if keys:
            yield block()

    return vectors.mapInArrow(build, f"keys ARRAY<{kind}>, rows BINARY")
