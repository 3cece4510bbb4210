"""Centroid clustering in exact integers, with heaps of bounds that say which vectors to look at again.

A vector's gap is the distance to its second nearest centroid minus that to its nearest. When centroids move,
the gap shrinks by no more than the move of its own centroid and the largest move among the others; these
drifts add up in one number a cluster. Each cluster of a block keeps a heap of gaps, each put in with the
drift of its time added, so nothing in the heap changes from round to round: the vectors at the top, whose
gap the drift has reached, are popped and measured against all centroids again; for the rest the owner stands.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.blocks import finite
from statuta.session import cut_lineage

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
BLOCK = 4096
#: What square roots and sums of drifts may round away, as a share and as a length.
SLACK = 1e-12
LEAST = 1e-9

#: A block with its state, as Spark and as Arrow name the types.
STATE = {
    "ids": ("ARRAY<BIGINT>", pa.list_(pa.int64())),
    "x": ("BINARY", pa.binary()),
    "owner": ("BINARY", pa.binary()),
    "heaps": (
        "ARRAY<STRUCT<keys: ARRAY<DOUBLE>, rows: ARRAY<INT>>>",
        pa.list_(pa.struct([("keys", pa.list_(pa.float64())), ("rows", pa.list_(pa.int32()))])),
    ),
    "moved": ("ARRAY<BIGINT>", pa.list_(pa.int64())),
    "distance": ("ARRAY<BIGINT>", pa.list_(pa.int64())),
    "cost": ("ARRAY<DECIMAL(38,0)>", pa.list_(pa.decimal128(38, 0))),
}


def integers(vecs: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held at a size of which no squared distance leaves 64 bits (2^27 at 64 components)."""
    most = math.isqrt((1 << 60) // max(1, vecs.shape[1]))
    return np.clip(np.floor(scale * vecs), -most, most).astype(np.int64)


def unpacked(raw: bytes, dimensions: int, rows: int) -> np.ndarray:
    kind = "<i2" if len(raw) == 2 * rows * dimensions else "<i4"
    return np.frombuffer(raw, kind).reshape(rows, dimensions).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    return x.astype("<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4").tobytes()


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exactly; by one matrix product where doubles hold every sum."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        both = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
        return both.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


@dataclass
class Centroids:
    """The centroids of a round, and for each cluster the drift of all rounds so far."""

    points: list[list[int]]
    drift: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.drift = self.drift or [0.0] * len(self.points)

    def moved(self, sums: list[list[int]], counts: list[int]) -> Centroids:
        """Every non-empty centroid at the floor of its mean; the drifts grow by what gaps may have lost."""
        points = [[s // n for s in total] if n else p for p, total, n in zip(self.points, sums, counts)]
        step = [math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q))) * (1 + SLACK) for p, q in zip(self.points, points)]
        drift = []
        for j, before in enumerate(self.drift):
            others = max((s for i, s in enumerate(step) if i != j), default=0.0)
            drift.append((before + step[j] + others) * (1 + SLACK))
        return Centroids(points, drift)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in self.points]


class Block:
    """Some vectors with their owners and, for each cluster, the heap of (gap plus drift, row)."""

    def __init__(self, x: np.ndarray, clusters: int):
        self.x = x
        self.owner = np.full(len(x), -1, np.int64)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]
        self.scanned = 0

    def expired(self, drift: list[float]) -> np.ndarray:
        """The vectors without an owner, or popped because the drift may have used up their gap."""
        out = np.nonzero(self.owner < 0)[0].tolist()
        for heap, gone in zip(self.heaps, drift):
            while heap and heap[0][0] <= gone + LEAST:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def assign(self, centroids: Centroids) -> np.ndarray:
        """Owners under the centroids; returns what sums and counts change, one line a cluster."""
        change = np.zeros((len(centroids.points), self.x.shape[1] + 1), np.int64)
        at = self.expired(centroids.drift)
        self.scanned = len(at)
        if not len(at):
            return change
        far = squared(self.x[at], np.array(centroids.points, np.int64))
        best = far.argmin(axis=1)  # the first of equals: the smaller number
        near = far[np.arange(len(at)), best]
        if far.shape[1] > 1:
            far[np.arange(len(at)), best] = np.iinfo(np.int64).max
            second = np.sqrt(far.min(axis=1).astype(np.float64))
            gap = second - np.sqrt(near.astype(np.float64)) - SLACK * (second + 1)
        else:
            gap = np.full(len(at), np.inf)
        before = self.owner[at]
        for row, j, g in zip(at.tolist(), best.tolist(), gap.tolist()):
            heapq.heappush(self.heaps[j], (g + centroids.drift[j], row))
        self.owner[at] = best
        with_one = np.c_[self.x[at], np.ones(len(at), np.int64)]
        new = before != best
        np.add.at(change, best[new], with_one[new])
        left = new & (before >= 0)
        np.subtract.at(change, before[left], with_one[left])
        return change

    def distances(self, points: list[list[int]]) -> np.ndarray:
        return ((self.x - np.array(points, np.int64)[self.owner]) ** 2).sum(axis=1)


def _blocks(rows: DataFrame, dimensions: int, scale: int, size: int) -> DataFrame:
    """Rows of up to `size` vectors each, in integers, without owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                x = integers(part.column(1).flatten().to_numpy().reshape(-1, dimensions), scale)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([packed(x)], pa.binary())], names=["ids", "x"])

    return rows.mapInArrow(run, "ids ARRAY<BIGINT>, x BINARY")


def _assigned(blocks: DataFrame, centroids: Centroids, dimensions: int, last: bool) -> DataFrame:
    """Every block with the owners of this round, its heaps, and the change of sums and counts."""
    clusters, first = len(centroids.points), "owner" not in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = row.column("ids")
                n = len(ids[0].values)
                block = Block(unpacked(row.column("x")[0].as_py(), dimensions, n), clusters)
                if not first:
                    block.owner = np.frombuffer(row.column("owner")[0].as_py(), "<i4").astype(np.int64)
                    block.heaps = [list(zip(h["keys"], h["rows"])) for h in row.column("heaps")[0].as_py()]
                change = block.assign(centroids)
                heaps = [{"keys": [k for k, _ in h], "rows": [r for _, r in h]} for h in block.heaps]
                far, cost = [], []
                if last:
                    d = block.distances(centroids.points)
                    far = d.tolist()
                    cost = [Decimal(sum(d[block.owner == j].tolist())) for j in range(clusters)]
                    heaps = []
                found = {
                    "x": b"" if last else row.column("x")[0].as_py(),
                    "owner": block.owner.astype("<i4").tobytes(),
                    "heaps": heaps,
                    "moved": change.ravel().tolist(),
                    "distance": far,
                    "cost": cost,
                }
                arrays = [ids, *(pa.array([found[c]], kind) for c, (_, kind) in STATE.items() if c != "ids")]
                yield pa.RecordBatch.from_arrays(arrays, names=list(STATE))

    return blocks.mapInArrow(run, ", ".join(f"{c} {kind}" for c, (kind, _) in STATE.items()))


def _total(blocks: DataFrame, column: str, places: int) -> list[int]:
    """The sums of an array column, place by place; as many numbers as it has places reach the driver."""
    found = (
        blocks.select(F.posexplode(column).alias("at", "v"))
        .groupBy("at")
        .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        .collect()
    )
    out = [0] * places
    for at, v in found:
        out[at] = int(v)
    return out


def _fits(v: int) -> int | None:
    return v if v < 1 << 63 else None


def cluster(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that takes part.

    Vectors with exactly `dimensions` components, none of them null or non-finite, take part, as integers
    floor(scale * x), held at a size of 2^27 (with 64 components). The centroids start as the vectors whose id, written behind
    `1:`, has the smallest SHA-256 (an id that is null is written `null`; of rows with one id, the smaller
    vector first); fewer vectors than clusters give fewer centroids. Each round assigns every vector to the
    nearest centroid (squared Euclidean distance, ties to the smaller number) and moves every non-empty one
    to the floor of its mean; then all are assigned once more. Repeated rows count as often as they stand.
    An inertia beyond 64 bits is null. An empty table gives an empty result; other columns are not read.

    Vectors stay in the blocks they are read into, nothing is shuffled but the sums; a round writes the
    blocks with owners and heaps to the shared folder, so a lost executor costs the tasks of one round.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(finite(F.col("vec")) & (F.size("vec") == dimensions))
    name = F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    first = rows.select(F.sha2(name, 256).alias("h"), "vec").orderBy("h", "vec").limit(clusters).collect()
    schema = f"`{id_col}` BIGINT, cluster INT, distance BIGINT, cluster_inertia BIGINT, inertia BIGINT, centroid_sha256 STRING"
    if not first:
        return spark.createDataFrame([], schema)
    starts = integers(np.array([r["vec"] for r in first]), scale)
    centroids = Centroids(starts.tolist())
    k, width = len(starts), dimensions + 1
    blocks, sums = _blocks(rows, dimensions, scale, block), [0] * (k * width)
    for turn in range(rounds + 1):
        blocks = cut_lineage(_assigned(blocks, centroids, dimensions, last=turn == rounds), "clusters")
        if turn < rounds:
            sums = [a + b for a, b in zip(sums, _total(blocks, "moved", k * width))]
            lines = [sums[j * width : (j + 1) * width] for j in range(k)]
            centroids = centroids.moved([line[:-1] for line in lines], [line[-1] for line in lines])
    cost = _total(blocks, "cost", k)
    inertias, inertia, digests = [_fits(c) for c in cost], _fits(sum(cost)), centroids.digests()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                owner = pa.array(np.frombuffer(batch.column(1)[i].as_py(), "<i4"))
                n = len(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i].values,
                        owner,
                        batch.column(2)[i].values,
                        pa.array(inertias, pa.int64()).take(owner),
                        pa.array([inertia] * n, pa.int64()),
                        pa.array(digests).take(owner),
                    ],
                    names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.select("ids", "owner", "distance").mapInArrow(run, schema)
