"""Packing of documents into training sequences with lexical neighbours.

Documents are dealt to shards of bounded size. A shard holds a BM25 inverted index of its documents, whose
term weights come from the document frequencies of the whole corpus (one count for each id of the
vocabulary, so their size is bounded by the vocabulary). A seed document opens a window; its best unused
neighbours fill it greedily; the one that does not fit is cut, and its rest opens the next window. All terms
of the seed count; neighbours in other shards are not seen.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.words import BLANK, PATTERN, PIECE, Memo, byte_letters, distinct_words, gathered, given_back, slices, special_pattern, stretches
from statuta.session import cut_lineage

WINDOW = 2048
END = 1
SHARD_IDS = 2_000_000
K1, B = 1.2, 0.75
#: Terms that occur in more than one of so many documents of a shard are kept as rows of a dense table.
DENSE = 8
#: Neighbours that are sorted at a time.
SORTED = 64
#: Words whose ids are gathered at a time, and the bytes of the store of pieces.
GATHER = 1 << 19
ROOM = 48 << 20
#: Bytes of distinct words that go to the engine in one text.
TOLD = 1 << 20


class Encoder:
    """Identifiers of whole texts as the `tokenizers` library gives them for a byte-level BPE file.

    The file's tokens are in the order of its merges, so they are also ranks: the faster engine of `tiktoken`
    reads the same file and gives the same ids (the tests hold both against each other).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in told["model"]["vocab"].items() if t not in special}
        merged = [ranks[bytes(map(letters.__getitem__, "".join(_pair(m))))] for m in told["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(*ranks.values(), *special.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = special_pattern(tuple(special))
        self.odd = "|".join([f" [{BLANK}]", " $", *map(re.escape, special)])
        self.specials = {t: self.kind.type(i).tobytes() for t, i in special.items()}
        self.engine = engine
        self.known = Memo(lambda piece: np.array(engine.encode_ordinary(piece), self.kind).tobytes(), ROOM)
        self.bytes_of = np.zeros(self.size, np.int64)
        self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, PIECE.findall(text)))

    def parted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words that stand between two blanks, each with the blank before it.

        The words go to the engine as one text, as no piece goes on behind a blank that a word follows; the bytes
        of the ids tell where each word ends.
        """
        sizes = pc.binary_length(pa.array(words, pa.string())).to_numpy() + 1
        told, counts, ends, lo = [], [], np.cumsum(sizes), 0
        while lo < len(words):
            start = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, start + TOLD, "right")))
            ids = self.engine.encode_to_numpy(" " + " ".join(words[lo:hi]), disallowed_special=())
            last = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends[lo:hi] - start) + 1
            told.append(ids.astype(self.kind))
            counts.append(np.diff(last, prepend=0))
            lo = hi
        return (np.concatenate(told), np.concatenate(counts)) if told else (np.zeros(0, self.kind), np.zeros(0, np.int64))

    def encode(self, text: str) -> bytes:
        """The identifiers of a text, little-endian, in the smallest kind that holds the vocabulary."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        found, at = [], 0
        for m in self.special.finditer(text):
            found += [self.plain(text[at : m.start()]), self.specials[m[0]]]
            at = m.end()
        return b"".join([*found, self.plain(text[at:])])

    def encode_all(self, texts: pa.Array, last: bytes) -> list[bytes]:
        return [ids for part in slices(texts) for ids in self.encode_part(part, last)]

    def encode_part(self, texts: pa.Array, last: bytes) -> list[bytes]:
        """The ids of every text with `last` behind them.

        A blank goes with what follows it, unless white space follows. Texts without such a place are cut at
        the blanks, and what stands between them is encoded once for all texts.
        """
        odd = pc.match_substring_regex(texts, self.odd)
        words, index, places = distinct_words(pc.if_else(odd, "", texts), " ")
        first = places[:-1]  # the word a text begins with has no blank before it
        opening, at = np.unique(index[first], return_inverse=True)
        index = index.astype(np.int64)
        index[first] = -1
        inner, index = np.unique(index, return_inverse=True)  # the others, one number less where there are first words
        some = int(len(inner) > 0 and inner[0] < 0)
        coded = [self.plain(words[i]) for i in opening.tolist()]
        ids, size = self.parted([words[i] for i in inner[some:].tolist()])
        index += len(coded) - some
        index[first] = at
        size = np.r_[np.array([len(c) for c in coded], np.int64) // self.kind.itemsize, size]
        begin, ids, out = np.cumsum(size) - size, np.concatenate([np.frombuffer(b"".join(coded), self.kind), ids]), []
        for lo, hi in stretches(places, GATHER):
            at = index[places[lo] : places[hi]]
            flat = ids[gathered(begin[at], size[at])]
            cuts = np.r_[0, np.cumsum(size[at])][places[lo : hi + 1] - places[lo]].tolist()
            out += [flat[a:b].tobytes() + last for a, b in zip(cuts, cuts[1:])]
        for i in np.nonzero(odd.to_numpy(zero_copy_only=False))[0].tolist():
            out[i] = self.encode(texts[i].as_py()) + last
        return out


def _pair(merge: str | list[str]) -> list[str]:
    return merge.split(" ") if isinstance(merge, str) else merge


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(doc_id, ids BINARY, n INT, spread BIGINT): the ids of every row with `end` behind them.

    `spread` differs for rows that are alike, so that repeated rows are dealt evenly.
    """

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(vocabulary), 0
        last = enc.kind.type(end).tobytes()
        try:
            for batch in batches:
                ids = enc.encode_all(batch.column(1), last)
                sizes = [len(x) // enc.kind.itemsize for x in ids]
                spread = [zlib.crc32(x[:4096], row + i) for i, x in enumerate(ids)]
                row += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(spread, pa.int64())],
                    names=["doc_id", "ids", "n", "spread"],
                )
        finally:
            enc.known.free()  # the worker outlives the task and keeps the vocabulary

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids BINARY, n INT, spread BIGINT")


def document_frequencies(ids: DataFrame, kind: np.dtype) -> DataFrame:
    """(id, n): in how many documents an id occurs; counts are summed in the task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                seen = np.unique(np.frombuffer(raw.as_buffer(), kind))
                if len(seen) and seen[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(seen[-1]) + 1 - len(total), np.int64)])
                total[seen] += 1
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return ids.select("ids").mapInArrow(count, "id BIGINT, n BIGINT").groupBy("id").agg(F.sum("n").alias("n"))


class Shard:
    """A BM25 index over a shard's documents, and the greedy filling of windows from it."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs, n = docs, len(docs)
        self.sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs).astype(np.int64)
        owner = np.repeat(np.arange(n), self.sizes)
        pairs, tf = np.unique(owner << 32 | flat, return_counts=True)
        self.owner, self.term = pairs >> 32, pairs & 0xFFFFFFFF
        norm = K1 * (1 - B + B * self.sizes / mean)
        self.weight = (idf[self.term] * tf * (K1 + 1) / (tf + norm[self.owner])).astype(np.float32)
        self.starts = np.searchsorted(self.owner, np.arange(n + 1))
        by_term = np.argsort(self.term, kind="stable")
        self.posted, self.impact = self.owner[by_term], self.weight[by_term]
        self.terms, first = np.unique(self.term[by_term], return_index=True)
        self.lists = np.append(first, len(by_term))
        often = np.nonzero(np.diff(self.lists) * DENSE > n)[0]
        self.row = np.full(len(self.terms), -1, np.int64)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        for row, i in enumerate(often):
            listed = slice(self.lists[i], self.lists[i + 1])
            self.dense[row, self.posted[listed]] = self.impact[listed]
        self.unused = np.ones(n, bool)
        self.left = n
        self.next = 0

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for all terms of the seed; nought for documents that are used."""
        at = np.searchsorted(self.terms, self.term[self.starts[doc] : self.starts[doc + 1]])
        row = self.row[at]
        spans = [slice(self.lists[i], self.lists[i + 1]) for i in at[row < 0]]
        score = self.dense[row[row >= 0]].sum(axis=0).astype(np.float64)
        if spans:
            score += np.bincount(
                np.concatenate([self.posted[s] for s in spans]),
                np.concatenate([self.impact[s] for s in spans]),
                len(self.docs),
            )
        return score * self.unused

    def neighbours(self, doc: int) -> np.ndarray:
        """Unused documents that share a term of weight with the seed, best first, ties by order."""
        return np.fromiter(self.ranked(doc), np.int64)

    def ranked(self, doc: int) -> Iterator[int]:
        """The neighbours, sorted as far as they are asked for."""
        score = self.scores(doc)
        found = np.nonzero(score)[0]
        while len(found):
            least = -np.partition(-score[found], SORTED - 1)[SORTED - 1] if len(found) > SORTED else 0.0
            best = score[found] >= least
            first = found[best]
            yield from first[np.argsort(-score[first], kind="stable")].tolist()
            found = found[~best]

    def take(self, doc: int) -> int:
        self.unused[doc] = False
        self.left -= 1
        return doc

    def first_unused(self) -> int | None:
        if not self.left:
            return None
        self.next += int(np.argmax(self.unused[self.next :]))
        return self.next

    def pieces(self, window: int) -> list[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset); the last, short window is cut to powers of two."""
        out: list[tuple[int, int, int, int, int]] = []
        sequence, filled, doc, start = 0, 0, None, 0
        queue: Iterator[int] = iter(())
        while True:
            if doc is None:
                doc = next((d for d in queue if self.unused[d]), None) if filled else None
                if doc is None:
                    doc = self.first_unused()
                if doc is None:
                    break
                self.take(doc)
                start = 0
            length = min(int(self.sizes[doc]) - start, window - filled)
            out.append((doc, start, length, sequence, filled))
            opened = filled == 0
            start, filled = start + length, filled + length
            if filled == window:
                sequence, filled = sequence + 1, 0
            elif opened and self.left:
                queue = self.ranked(doc)
            if start == self.sizes[doc]:
                doc = None
        tail = []
        while out and out[-1][3] == sequence:
            tail.append(out.pop())
        bits = [1 << b for b in range(window.bit_length(), -1, -1) if filled >> b & 1]
        room, offset = (bits.pop(0) if bits else 0), 0
        for doc, start, length, _, _ in reversed(tail):
            while length:
                part = min(length, room - offset)
                out.append((doc, start, part, sequence, offset))
                start, length, offset = start + part, length - part, offset + part
                if offset == room and bits:
                    sequence, room, offset = sequence + 1, bits.pop(0), 0
        return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end: int = END,
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents.

    Every window is filled to the last place; what is left in a shard at the end becomes sequences whose
    lengths are powers of two, so nothing is padded. A null or empty text is a document of one id, `end`.
    Repeated rows and rows without an id are packed like any other. Ties between neighbours go to the one
    that comes first in the shard's order (by id). An empty table gives an empty result; columns other than
    the two named ones are not read. A document longer than a window fills several, its last piece seeds
    the rest of its window.
    """
    spark = docs.sparkSession
    rows = cut_lineage(encoded(docs, vocabulary, id_col, text_col, end), "ids")
    kind = encoder(vocabulary).kind
    n_docs, n_ids = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = document_frequencies(rows, kind).toArrow()
    df = np.zeros(max(encoder(vocabulary).size, end + 1), np.int64)
    df[counts["id"].to_numpy()] = counts["n"].to_numpy()
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    idf[end] = 0.0  # it ends every document
    mean = max(1.0, n_ids / max(1, n_docs))
    shards = max(1, math.ceil(n_ids / shard_ids))
    shared = spark.sparkContext.broadcast(idf)

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("spread", "ascending")]).combine_chunks()
        ids = [np.frombuffer(raw.as_buffer(), kind) for raw in group["ids"]]
        pieces = Shard(ids, shared.value, mean).pieces(window)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
        crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
        base = group["shard"][0].as_py() << 32
        pa.default_memory_pool().release_unused()
        return pa.table(
            {
                id_col: group["doc_id"].take(pa.array(doc)),
                "start": start,
                "length": length,
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": group["n"].take(pa.array(doc)).cast(pa.int64()),
                "sequence_id": sequence + base,
                "offset": offset,
            }
        )

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "spread"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(
        packed,
        f"`{id_col}` {rows.schema['doc_id'].dataType.simpleString()}, start BIGINT, length BIGINT, ids_crc32 BIGINT, "
        "doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT",
    )
