"""Token counts by byte-pair merging, without producing identifiers.

A piece of text starts as a chain of byte symbols. A heap holds the adjacent pairs the vocabulary can merge;
the pair of lowest rank (leftmost among equals) is popped, checked against the chain as it stands now, and
merged. The number of tokens is the number of symbols minus the number of merges.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.words import PATTERN, PIECE, ROOM, Memo, byte_letters, special_pattern

WORD = regex.compile(PATTERN)


class Merges:
    """Ranks of the mergeable pairs, read from a vocabulary file.

    Symbols are numbered 0 to 255 for bytes and 256 + r for the result of the merge of rank r.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.specials = tuple(t["content"] for t in told["added_tokens"])
        number = byte_letters()
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[number[left], number[right]] = rank
            number[left + right] = 256 + rank

    def count(self, word: bytes) -> int:
        """Symbols left when no pair can be merged any more."""
        end = len(word)
        if end < 2:
            return end
        rank_of = self.ranks.get
        offered = list(map(rank_of, zip(word, word[1:])))  # by place: the rank of the pair that starts there
        heap = [rank << 32 | at for at, rank in enumerate(offered) if rank is not None]
        if not heap:
            return end
        heapq.heapify(heap)
        offered.append(None)
        chain, before, after = list(word), list(range(-1, end - 1)), list(range(1, end + 1))
        merges, pop, push = 0, heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            at, rank = top & 0xFFFFFFFF, top >> 32
            if offered[at] != rank:
                continue  # one of the two was merged with another neighbour meanwhile
            merges += 1
            joined = chain[at] = 256 + rank
            gone = after[at]
            offered[gone] = None
            follower = after[at] = after[gone]
            if follower < end:
                before[follower] = at
                rank = offered[at] = rank_of((joined, chain[follower]))
                if rank is not None:
                    push(heap, rank << 32 | at)
            else:
                offered[at] = None
            leader = before[at]
            if leader >= 0:
                rank = offered[leader] = rank_of((chain[leader], joined))
                if rank is not None:
                    push(heap, rank << 32 | leader)
        return end - merges


class Counter:
    """Counts of texts; one for each vocabulary and worker, with the counts of pieces met so far."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.special = special_pattern(self.merges.specials)
        self.words = Memo(lambda w: self.merges.count(w.encode()), ROOM // 2)
        self.pieces = Memo(self.piece, ROOM // 2)

    def piece(self, piece: str) -> int:
        if (piece[1:] if piece[0] == " " else piece).isalpha():
            return self.words[piece]
        return sum(map(self.words.__getitem__, WORD.findall(piece)))

    def plain(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, PIECE.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token and parts what stands around it."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    `vocabulary` is the path of a byte-level BPE file that every worker can open. A null text counts as
    empty: zero bytes, zero tokens. Repeated rows and null ids are kept as they are; an empty table gives an
    empty result; columns other than the two named ones are not read. Texts of any length are counted whole.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = pa.array(map(count, texts), pa.int64())
            sizes = pa.array((len(t.encode()) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, tokens], names=[id_col, "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(counted, f"`{id_col}` {kind}, n_bytes BIGINT, n_tokens BIGINT")
    return found.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
