"""Vectors in blocks, and the meeting of every block of queries with every block of candidates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES = 8192
QUERIES = 1024


def finite(vec: Column) -> Column:
    """Vectors with at least one component, none of them null or non-finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, odd)


def _blocks(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, vec) of a task as blocks of at most `rows` vectors of one length."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(size: int) -> pa.RecordBatch:
            ids, vecs = (np.concatenate(x) for x in zip(*held.pop(size)))
            return pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int32()), pa.array([int(ids[0])], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([vecs.tobytes()], pa.binary())],
                names=["size", "first", "ids", "vecs"],
            )

        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(), batch.column(1)
            flat = vecs.flatten().to_numpy().astype("<f8")
            sizes = np.diff(vecs.offsets.to_numpy())
            begin = np.r_[0, np.cumsum(sizes)[:-1]]
            for size in map(int, np.unique(sizes)):
                at = np.nonzero(sizes == size)[0]
                for lo in range(0, len(at), rows):
                    part = at[lo : lo + rows]
                    room = rows - sum(len(i) for i, _ in held.get(size, []))
                    if room < len(part):
                        yield block(size)
                    held.setdefault(size, []).append((ids[part].astype("<i8"), flat[begin[part, None] + np.arange(size)]))
        for size in list(held):
            yield block(size)

    return build


def meetings(
    vectors: DataFrame, queries: DataFrame, candidate_rows: int = CANDIDATES, query_rows: int = QUERIES
) -> DataFrame:
    """One row for each block of queries and block of candidates of the same vector length.

    Both frames are (id BIGINT, vec ARRAY<DOUBLE>). Candidates stay where they are read; each block goes to
    a slot, and a copy of every query block goes to each slot, so the exchange grows with query blocks times
    slots and a task holds two blocks at a time. Rows come in order of their query blocks.
    """
    n, n_queries = vectors.count(), queries.count()
    slots = max(1, math.ceil(n / candidate_rows))
    ddl = "size INT, first BIGINT, ids BINARY, vecs BINARY"
    right = vectors.mapInArrow(_blocks(candidate_rows), ddl).select(
        F.pmod(F.xxhash64("first", "size"), F.lit(slots)).cast("int").alias("slot"), "size", F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs")
    )
    left = queries.repartition(max(1, math.ceil(n_queries / query_rows)), "id").mapInArrow(_blocks(query_rows), ddl).select(
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "size", F.col("first").alias("block"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")
    )
    return (
        left.hint("shuffle_merge")
        .join(right, ["slot", "size"])
        .select("slot", "size", "block", "q_ids", "q_vecs", "c_ids", "c_vecs")
        .sortWithinPartitions("size", "block", "slot")
    )


def unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}_ids"], "<i8")
    return ids, np.frombuffer(row[f"{side}_vecs"], "<f8").reshape(len(ids), row["size"])


class Best:
    """Per query of one block: the k best candidates so far, by score and then smaller id."""

    def __init__(self, queries: np.ndarray, k: int, kind: type):
        self.queries, self.k = queries, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, kind), np.zeros(0, np.int64))] * len(queries)

    def floor(self, q: int):
        """The k-th best score so far, None while there are fewer."""
        score, _ = self.found[q]
        return score[-1] if len(score) == self.k else None

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.found[q][0], score]), np.concatenate([self.found[q][1], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.found[q] = score[order], ids[order]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.found]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.queries, sizes)), pa.array(np.concatenate([i for _, i in self.found])), pa.array(np.concatenate([s for s, _ in self.found]))],
            names=["query_id", "vec_id", "score"],
        )


def search(met: DataFrame, k: int, kind: str, visit: Callable[[dict, Best], None]) -> DataFrame:
    """(query_id, rank, vec_id, score): `visit` adds a meeting's candidates to the best of its queries.

    A task carries the best of one query block from meeting to meeting and hands on k rows a query; these
    are ranked once more over all tasks.
    """
    number = np.float64 if kind == "DOUBLE" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if best is None or now != (row["size"], row["q_ids"]):
                    if best is not None:
                        yield best.rows()
                    now = row["size"], row["q_ids"]
                    best = Best(np.frombuffer(row["q_ids"], "<i8"), k, number)
                visit(row, best)
        if best is not None:
            yield best.rows()

    from pyspark.sql import Window

    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.mapInArrow(run, f"query_id BIGINT, vec_id BIGINT, score {kind}")
        .withColumn("rank", F.row_number().over(ordered))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query_rows(vectors: DataFrame, every: int) -> DataFrame:
    """The vectors whose id is divisible by `every`; an id that stands in several rows asks once."""
    return vectors.where(F.col("id") % every == 0).dropDuplicates(["id"])


def prepared(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: an id and a finite vector."""
    vec = F.col(vec_col).cast("array<double>")
    return table.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & finite(F.col("vec")))
