"""Nearest neighbours by inner product through int8 tiles with error bounds.

Each vector is scaled to int8; the product of two int8 blocks gives every inner product up to a bound that
follows from the two rounding errors. A pair whose upper bound lies below the k-th best lower bound of its
query cannot be among the k nearest; the others are recomputed from the original components in double
precision. Nothing is approximate in the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.blocks import CANDIDATES, QUERIES, Best, meetings, prepared, query_rows, search, unpack

NEAREST = 20
EVERY = 20


def quantised(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the norms of its rounded vector and of its error."""
    scale = np.abs(vecs).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)  # a component may be too small to be divided
    codes = np.rint(vecs / scale[:, None]).astype(np.int8)
    rounded = codes * scale[:, None]
    return codes, scale, _norm(rounded), _norm(vecs - rounded)


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def tile(q, c, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and error bounds of all inner products of two quantised blocks."""
    # products of int8 codes add up exactly in float32 below 2^24, that is up to 1,040 components
    kind = np.float32 if width <= 1040 else np.float64
    estimate = (q[0].astype(kind) @ c[0].astype(kind).T).astype(np.float64) * q[1][:, None] * c[1]
    bound = q[3][:, None] * c[2] + q[2][:, None] * c[3] + q[3][:, None] * c[3]
    return estimate, bound + 1e-9 * (q[2] + q[3])[:, None] * (c[2] + c[3])  # and what doubles round away


def nearest(
    vectors: DataFrame,
    k: int = NEAREST,
    every: int = EVERY,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    candidate_rows: int = CANDIDATES,
    query_block: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with other rows.

    Queries are the rows whose id is divisible by `every`; candidates are all rows with another id. Rows
    whose id or vector is null, or whose vector is empty, zero, or holds null or non-finite components, take
    no part; only vectors of the query's length are its candidates. Equal scores go to the smaller id. A
    candidate that stands in several rows is listed as often; a repeated query id asks once. An empty table
    gives an empty result; other columns are not read.
    """
    rows = prepared(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))

    def visit(row: dict, best: Best) -> None:
        (q_ids, q), (c_ids, c) = unpack(row, "q"), unpack(row, "c")
        step = max(1, (1 << 21) // len(c_ids))  # queries a tile, so that a tile stays at 16 MB
        coded = quantised(c)
        for lo in range(0, len(q_ids), step):
            part = q[lo : lo + step]
            estimate, bound = tile(quantised(part), coded, row["size"])
            own = q_ids[lo : lo + step, None] == c_ids
            low = np.where(own, -np.inf, estimate - bound)
            kth = np.partition(low, -k, axis=1)[:, -k] if len(c_ids) > k else np.full(len(part), -np.inf)
            high = np.where(own, -np.inf, estimate + bound)
            for i in range(len(part)):
                floor = best.floor(lo + i)
                least = kth[i] if floor is None else max(kth[i], floor)
                left = np.nonzero((high[i] >= least) & ~own[i])[0]
                if len(left):
                    best.add(lo + i, (c[left] * part[i]).sum(axis=1), c_ids[left])

    return search(meetings(rows, query_rows(rows, every), candidate_rows, query_block), k, "DOUBLE", visit)
