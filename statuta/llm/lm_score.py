"""Language-model scores by a weighted backoff automaton.

States are the histories of a smoothed bigram model: one for each word, one for the start of a text, and the
root. A history has an arc for each word seen behind it and a failure arc to the root, where every word has an
arc and unknown words share one. A text is traversed once from left to right: at each word the state's own arc
is taken or else the failure arc and the root's, weights add up, and the word becomes the state.

The automaton of a large corpus fits no machine. Documents are therefore dealt to blocks of bounded size.
Each block counts its own words and pairs and sends the counts out, its sorted keys cut into the ranges of the key
space that meet elsewhere; the totals come back in the order of the keys, so keys travel once, as differences. With
the totals a block has exactly the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
#: Share of a history's probability that its own arcs hold; the failure arc has the rest.
ARC_SHARE = 0.4
END, START = b"\n", b" "  # no word holds white space
HELD_OUT = 7, 2
FLUSH = 400_000


def held_out(id_col: str) -> Column:
    """Rows kept from training; a row without an id is not."""
    every, rest = HELD_OUT
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % every == rest, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the blanks \\x20 and \\x09-\\x0D, and the end."""
    found = (text or "").encode().lower().split()
    found.append(END)
    return found


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs from the keys of their words."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Block:
    """Words and pairs of a block of texts, with the counts of its training texts."""

    def __init__(self, texts: list[str | None], train: np.ndarray):
        numbers = _Numbers()
        start = numbers[START]
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = words(text)
            sizes[i] = len(found)
            flat.extend(map(numbers.__getitem__, found))
        self.sizes, self.starts = sizes, np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        self.word = np.array(flat, np.int64)
        before = np.r_[start, self.word[:-1]] if len(self.word) else self.word
        before[self.starts] = start
        n = len(numbers)
        learnt = np.repeat(train, sizes)
        pairs, self.pair = np.unique(before * n + self.word, return_inverse=True)
        self.history, self.follower = pairs // n, pairs % n
        word_keys = np.fromiter(map(word_key, numbers), np.uint64, n)
        self.keys = np.concatenate([word_keys, _pair_keys(word_keys[self.history], word_keys[self.follower])])
        own = np.bincount(self.word[learnt], minlength=n)
        own[start] = int(train.sum())  # how often the state was a history
        self.own = np.concatenate([own, np.bincount(self.pair[learnt], minlength=len(pairs))])
        self.n_words = n

    def pieces(self, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the keys, and where each range of the key space begins in it."""
        order = np.argsort(self.keys)
        # the upper half of a key, scaled: ranges are even, as keys are hashes
        place = ((self.keys[order] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        return order, np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64))


def planes(numbers: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones and so on; empty planes compress away."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


@dataclass(frozen=True)
class Corpus:
    """What the model needs of all training tokens: their number, kinds, and kinds met once and twice."""

    tokens: int
    kinds: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5

    def root(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of the root's arcs; what is discounted from known words is the unknown word's."""
        if not self.tokens:
            return np.ones(len(counts))
        known = (counts - self.discount) / self.tokens
        return np.where(counts > 0, known, self.discount * self.kinds / self.tokens)


class Automaton:
    """The part of the automaton that the texts of one block reach; weights are log10 probabilities."""

    def __init__(self, block: Block, totals: np.ndarray, corpus: Corpus, share: float):
        count, seen = totals[: block.n_words], totals[block.n_words :]
        root = corpus.root(count)
        self.root = np.log10(root)
        self.failure = np.where(count > 0, math.log10(1 - share), 0.0)  # an unseen history is the root
        history = count[block.history]
        self.has_arc = seen > 0
        own = share * seen / np.maximum(1, history) + (1 - share) * root[block.follower]
        self.arc = np.log10(own)

    def traverse(self, block: Block) -> np.ndarray:
        """Log probability of each text. The state before a word is the word before it, so the arcs of all
        steps are looked up together and added up from left to right."""
        weight = np.where(
            self.has_arc, self.arc, self.failure[block.history] + self.root[block.follower]
        )[block.pair]
        return np.add.reduceat(weight, block.starts)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray]]:
    """Rows (block, train, text) in order of their blocks, one block at a time."""
    now, texts, train = None, [], []
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.nonzero(blocks[1:] != blocks[:-1])[0] + 1), len(blocks)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if blocks[lo] != now:
                if texts:
                    yield now, texts, np.array(train, bool)
                now, texts, train = blocks[lo], [], []
            train += batch.column(1).slice(lo, hi - lo).to_pylist()
            texts += batch.column(2).slice(lo, hi - lo).to_pylist()
    if texts:
        yield now, texts, np.array(train, bool)


def _block_counts(ranges: int):
    """Counts of each block by range: (range, block, keys, counts), keys sorted and as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, texts, train in _by_block(batches):
            block = Block(texts, train)
            order, cuts = block.pieces(ranges)
            keys, counts = block.keys[order], block.own[order].astype(np.uint32)
            used = np.nonzero(cuts[1:] > cuts[:-1])[0]
            spans = [slice(cuts[r], cuts[r + 1]) for r in used]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used.astype(np.int32)),
                    pa.array(np.full(len(used), number, np.int32)),
                    pa.array([planes(np.diff(keys[s], prepend=np.uint64(0))) for s in spans], pa.binary()),
                    pa.array([planes(counts[s]) for s in spans], pa.binary()),
                ],
                names=["range", "block", "keys", "counts"],
            )

    return run


def _range_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their ranges; a block's totals go back in the order of its keys."""

    def summed(rows: list[tuple]) -> pa.RecordBatch:
        keys = [np.cumsum(unplaned(k, np.uint64), dtype=np.uint64) for _, _, k, _ in rows]
        counts = np.concatenate([unplaned(c, np.uint32) for _, _, _, c in rows])
        _, same = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(same, counts).astype(np.int64)[same]
        cuts = np.cumsum([0, *map(len, keys)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r for r, _, _, _ in rows], pa.int32()),
                pa.array([b for _, b, _, _ in rows], pa.int32()),
                pa.array([planes(total[lo:hi]) for lo, hi in zip(cuts, cuts[1:])], pa.binary()),
            ],
            names=["range", "block", "totals"],
        )

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][0] != row[0]:
                yield summed(held)
                held = []
            held.append(row)
    if held:
        yield summed(held)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, summed in the task as far as memory allows."""
    from collections import Counter

    def flushed() -> pa.RecordBatch:
        keys = np.fromiter(map(word_key, held), np.uint64, len(held)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(held.values()), pa.int64())], names=["key", "n"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(words(text))
            if len(held) > FLUSH:
                yield flushed()
                held.clear()
    yield flushed()


def corpus_counts(rows: DataFrame) -> Corpus:
    """Exact figures over all training tokens; words meet by a 64-bit hash."""
    counts = rows.where("train").select("text").mapInArrow(_word_counts, "key BIGINT, n BIGINT")
    total = counts.groupBy("key").agg(F.sum("n").alias("n"))
    found = total.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.count(F.lit(1)),
        F.count(F.when(F.col("n") == 1, 1)),
        F.count(F.when(F.col("n") == 2, 1)),
    ).first()
    return Corpus(*map(int, found))


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = ARC_SHARE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    `score` is the model's log10 probability of the text over known words and one unknown word, `base_score`
    the add-one unigram's. A null or empty text has one token, the end. Rows without an id are learnt from
    and scored. Repeated rows are counted and come back as often as they stand in the table. Without training
    rows every probability is one. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (~held_out(id_col)).alias("train")
    )
    corpus = corpus_counts(rows)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    # all columns, though the id is not needed here: so both uses of the dealt rows share one exchange
    counted = dealt.select("block", "train", "text", "id").sortWithinPartitions("block").mapInArrow(
        _block_counts(blocks), "range INT, block INT, keys BINARY, counts BINARY"
    )
    # a block has a key once, so a common word or pair is one entry a block, however often it occurs
    sent = counted.repartition(blocks, "range").sortWithinPartitions("range").mapInArrow(
        _range_totals, "range INT, block INT, totals BINARY"
    )

    def scored(texts: pa.Table, totals: pa.Table) -> pa.Table:
        held = ~texts["train"].to_numpy()
        block = Block(texts["text"].to_pylist(), ~held)
        order, _ = block.pieces(blocks)
        total = np.zeros(len(order), np.int64)
        rows = sorted(zip(totals["range"].to_pylist(), totals["totals"].to_pylist()))
        total[order] = np.concatenate([unplaned(t, np.int64) for _, t in rows])
        count = total[block.word]
        base = np.log10((count + 1) / (corpus.tokens + corpus.kinds + 1))
        return pa.table(
            {
                id_col: texts["id"],
                "held_out": held,
                "n_tokens": block.sizes,
                "n_known": np.add.reduceat((count > 0).astype(np.int64), block.starts),
                "train_tokens": np.full(len(held), corpus.tokens, np.int64),
                "base_score": np.add.reduceat(base, block.starts),
                "score": Automaton(block, total, corpus, share).traverse(block),
            }
        )

    kind = rows.schema["id"].dataType.simpleString()
    return (
        dealt.groupBy("block")
        .cogroup(sent.groupBy("block"))
        .applyInArrow(
            scored,
            f"`{id_col}` {kind}, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE",
        )
    )
