"""Exact top-k by MaxScore over sharded postings of signed integer components.

A component above zero is a posting of the term (dimension, +), one below zero of (dimension, -); the impact
is its size. A query's terms are the ones of its own signs; a posting of the opposite sign only lowers a
score. In each shard the query's terms are ordered by the most they can add there. Those at the end whose
bounds together stay below the k-th best score are non-essential: a row that occurs in none of the other
lists cannot win. The essential lists are traversed; the rest is probed, largest bound first, for rows that
can still reach the k-th best score. Shards are merged by their k best.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from statuta.llm.blocks import CANDIDATES, QUERIES, Best, meetings, prepared, query_rows, search, unpack

BEST = 5
EVERY = 50
SCALE = 256
SEEDS = 64


class Shard:
    """Postings by dimension and sign, with the largest impact of each, and the components by column."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray):
        self.ids = ids
        self.columns = np.ascontiguousarray(parts.T)
        self.lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.most = np.zeros((2, len(self.columns)), np.int64)
        for d, column in enumerate(self.columns):
            for sign in (0, 1):
                at = np.nonzero(column < 0 if sign else column > 0)[0]
                self.lists[d, sign] = at, np.abs(column[at])
                self.most[sign, d] = np.abs(column[at]).max(initial=0)

    def top(self, query: np.ndarray, own: int, floor: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of rows that may be among the k best; all rows above `floor` are among them."""
        other = self.ids != own
        if floor is None:
            first = np.nonzero(other)[0][: max(SEEDS, k)]
            score = query @ self.columns[:, first]
            if len(first) >= k:
                floor = int(np.partition(score, -k)[-k])
        if floor is None or floor <= 0:  # rows without any of the query's terms count as well
            at = np.nonzero(other)[0]
            return query @ self.columns[:, at], self.ids[at]
        sign = (query < 0).astype(np.int8)
        bound = np.abs(query) * self.most[sign, np.arange(len(query))]
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from here on can add
        essential = int(np.argmax(rest < floor))
        score = np.zeros(len(self.ids), np.int64)
        seen = np.zeros(len(self.ids), bool)
        for d in order[:essential]:
            at, impact = self.lists[int(d), int(sign[d])]
            score[at] += abs(int(query[d])) * impact
            seen[at] = True
        left = np.nonzero(seen & other)[0]
        left = left[score[left] + rest[essential] >= floor]
        part = score[left]
        for d in order[:essential]:  # the opposite signs of the traversed terms
            part += np.minimum(0, query[d] * self.columns[d, left])
        for place in range(essential, len(order)):
            keep = part + rest[place] >= floor
            left, part = left[keep], part[keep]
            if not rest[place] and not len(left):
                break
            d = order[place]
            part = part + query[d] * self.columns[d, left]
        return part, self.ids[left]


def top_scores(
    vectors: DataFrame,
    k: int = BEST,
    every: int = EVERY,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = SCALE,
    candidate_rows: int = CANDIDATES,
    query_block: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with other rows.

    Components become floor(scale * x), computed in double precision; sums are exact while they fit 64 bits.
    Queries are the rows whose id is divisible by `every`; candidates are all rows with another id and a
    vector of the same length. Rows whose id or vector is null, or whose vector is empty or holds null or
    non-finite components, take no part; a zero vector scores zero. Equal scores go to the smaller id. A
    candidate that stands in several rows is listed as often; a repeated query id asks once. An empty table
    gives an empty result; other columns are not read.
    """
    rows = prepared(vectors, id_col, vec_col)
    held: dict[bytes, Shard] = {}

    def visit(row: dict, best: Best) -> None:
        q_ids, q = unpack(row, "q")
        if row["c_ids"] not in held:
            held.clear()
            c_ids, c = unpack(row, "c")
            held[row["c_ids"]] = Shard(c_ids, np.floor(c * scale).astype(np.int64))
        shard, queries = held[row["c_ids"]], np.floor(q * scale).astype(np.int64)
        for i, query in enumerate(queries):
            best.add(i, *shard.top(query, int(q_ids[i]), best.floor(i), k))

    return search(meetings(rows, query_rows(rows, every), candidate_rows, query_block), k, "BIGINT", visit)
