"""BM25 over a table of units for a table of queries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.text import fold, settled
from statuta.functions.tokens import words
from statuta.operators.listed import few, listed_scores
from statuta.operators.scale import fits, salted_join
from statuta.session import cut_lineage

SCORE_DIGITS = 9


#: Distinct words of all queries up to which the tasks get them as a list.
ASKED = 100_000
#: Bytes of text whose words are counted together.
SLICE = 8 << 20
#: Letters of folded words, their hyphens and what lies beyond ASCII; all others become blanks.
LETTERS = np.array([c if c > 127 or chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789-" else 32 for c in range(256)], np.uint8)
PLAIN, COMPOUND = re.compile("[a-z0-9]+"), re.compile("[a-z]+(?:-[a-z]+)+")


@dataclass(frozen=True)
class TextStatistics:
    """Words per unit where they are read, or the counts of a stored index, and the corpus totals."""

    tokens: DataFrame | None  # unit_key, len, words
    totals: DataFrame  # one row: units, words, avg_len
    stored: DataFrame | None = None  # unit_key, word, tf, len
    rows: DataFrame | None = None  # unit_key, len, hits: the stored counts with all words of a unit in one row

    def term_frequency(self) -> DataFrame:
        """(unit_key, word, tf, len)."""
        return counted(self.tokens) if self.stored is None else self.stored

    def term_frequency_of(self, asked: DataFrame, small: bool) -> DataFrame:
        """Term counts of the asked words only; other words never leave the row they stand in."""
        rows = self._exploded() if self.stored is None else self.stored
        if small:
            rows = rows.join(F.broadcast(asked), "word", "left_semi")
        else:
            rows = salted_join(rows, asked, ["word"])
        return self._grouped(rows) if self.stored is None else rows

    def _exploded(self) -> DataFrame:
        return self.tokens.select("unit_key", "len", F.explode("words").alias("word"))

    def _grouped(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("unit_key", "word").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"))

    def document_frequency(self) -> DataFrame:
        """(word, df), counted on the per-unit distinct words (partial sums before the shuffle)."""
        if self.stored is not None:
            return self.stored.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        return (
            self.tokens.select(F.explode(F.array_distinct("words")).alias("word"))
            .groupBy("word")
            .agg(F.count(F.lit(1)).alias("df"))
        )

    def weights(self) -> DataFrame:
        """(unit_key, token, weight): a word's share of its unit."""
        return self.term_frequency().select("unit_key", F.col("word").alias("token"), (F.col("tf") / F.col("len")).alias("weight"))

    def listed_weights(self) -> DataFrame:
        """(unit_key, items): the same with all words of a unit in one row."""
        return self.rows.select(
            "unit_key", F.transform("hits", lambda h: F.struct(h["word"].alias("token"), (h["tf"] / F.col("len")).alias("value"))).alias("items")
        )


def counted_rows(tokens: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """(unit_key, len, hits) of rows (unit_key, len, words): word and count of the asked words, of all without a list.

    Counted where the row stands, without an exchange: the words of an Arrow batch become numbers once, and
    one sort of (row, number) counts them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else pa.array(asked, pa.string())
        for batch in batches:
            lists = batch.column(2)
            listed = lists.flatten().dictionary_encode()
            sizes = np.diff(np.asarray(lists.offsets)) * lists.is_valid().to_numpy(zero_copy_only=False)
            n = max(1, len(listed.dictionary))
            seen = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * n + listed.indices.to_numpy()
            if wanted is not None:
                some = pc.is_in(listed.dictionary, value_set=wanted).to_numpy(zero_copy_only=False)
                seen = seen[some[listed.indices.to_numpy()]]
            seen, tf = np.unique(seen, return_counts=True)
            ends = np.r_[0, np.cumsum(np.bincount(seen // n, minlength=len(sizes)))].astype(np.int32)
            hits = pa.StructArray.from_arrays([listed.dictionary.take(pa.array(seen % n)), pa.array(tf.astype(np.int64))], names=["word", "tf"])
            rows = pa.ListArray.from_arrays(pa.array(ends), hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["unit_key", "len", "hits"])

    kind = tokens.schema["unit_key"].dataType.simpleString()
    return tokens.select("unit_key", "len", "words").mapInArrow(
        count, f"unit_key {kind}, len INT, hits ARRAY<STRUCT<word: STRING, tf: BIGINT>>"
    )


def counted_texts(units: DataFrame, text: str, asked: list[str] | None = None) -> DataFrame:
    """`counted_rows` of units (unit_key, text), whose words are cut where they are counted.

    Texts are folded natively. What stands between two ASCII characters that no word holds is looked at once for
    all texts of a slice: mostly it is a word; where it has hyphens or lies beyond ASCII, it is decomposed and cut as
    `words` does it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else pa.array(asked, pa.string())
        for batch in batches:
            lo = 0
            for sizes, hits in text_counts(batch.column(1), wanted):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sizes)), sizes, hits], names=["unit_key", "len", "hits"])
                lo += len(sizes)

    kind = units.schema["unit_key"].dataType.simpleString()
    return units.select("unit_key", fold(F.col(text)).alias("text")).mapInArrow(
        count, f"unit_key {kind}, len INT, hits ARRAY<STRUCT<word: STRING, tf: BIGINT>>"
    )


def text_counts(texts: pa.Array, wanted: pa.Array | None = None) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Number of words, and (word, tf) of the wanted ones or of all, of folded texts: a slice of them at a time."""
    stop = pa.array(K.STOP_WORDS, pa.string())
    ends, lo = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        part = texts.slice(lo, hi - lo)
        sizes, hits = _count(part.cast(pa.string()).fill_null(""), stop, wanted)
        yield pa.array(sizes, pa.int32(), mask=part.is_null().to_numpy(zero_copy_only=False)), hits
        lo = hi


def _count(texts: pa.Array, stop: pa.Array, wanted: pa.Array | None) -> tuple[np.ndarray, pa.ListArray]:
    """How many words each folded text has, and how often it has the wanted ones."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = LETTERS[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(raw))
    listed = pc.ascii_split_whitespace(plain)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(np.asarray(listed.offsets)))
    listed = listed.flatten().dictionary_encode()
    at, met = listed.indices.to_numpy(), listed.dictionary
    size = pc.binary_length(met).to_numpy()
    other = pc.match_substring(met, "-").to_numpy(zero_copy_only=False) | (size > pc.utf8_length(met).to_numpy())
    word = ~other & (size >= 2) & ~pc.is_in(met, value_set=stop).to_numpy(zero_copy_only=False)
    parts, stopped = {}, set(K.STOP_WORDS)
    for i, found in zip(np.nonzero(other)[0].tolist(), met.filter(pa.array(other)).to_pylist()):
        found = unicodedata.normalize("NFKD", found).encode("ascii", "ignore").decode()
        parts[i] = [w for w in PLAIN.findall(found) if len(w) >= 2 and w not in stopped]
        parts[i] += [w for c in COMPOUND.findall(found) for w in c.split("-") if len(w) > 2 and w not in stopped]
    if wanted is None:
        more = pa.array([w for ws in parts.values() for w in ws], pa.string())
        wanted = pc.unique(pa.concat_arrays([met.filter(pa.array(word)), more]))
    # words of each distinct piece, one after another
    many = word.astype(np.int64)
    many[list(parts)] = [len(ws) for ws in parts.values()]
    first = np.cumsum(many) - many
    place = np.full(int(many.sum()), -1, np.int64)
    place[first[word]] = pc.index_in(met.filter(pa.array(word)), value_set=wanted).fill_null(-1).to_numpy()
    flat = pa.array([w for ws in parts.values() for w in ws], pa.string())
    inside = [np.arange(first[i], first[i] + len(ws)) for i, ws in parts.items()]
    if len(flat):
        place[np.concatenate(inside)] = pc.index_in(flat, value_set=wanted).fill_null(-1).to_numpy()
    m = many[at]
    sizes = np.bincount(row, m, len(texts)).astype(np.int32)
    row, seen = np.repeat(row, m), place[np.repeat(first[at] - np.cumsum(m) + m, m) + np.arange(m.sum())]
    n = max(1, len(wanted))
    seen, tf = np.unique((row * n + seen)[seen >= 0], return_counts=True)
    ends = np.r_[0, np.cumsum(np.bincount(seen // n, minlength=len(texts)))].astype(np.int32)
    hits = pa.StructArray.from_arrays([wanted.take(pa.array(seen % n)), pa.array(tf.astype(np.int64))], names=["word", "tf"])
    return sizes, pa.ListArray.from_arrays(pa.array(ends), hits)


def postings(rows: DataFrame) -> DataFrame:
    """(unit_key, word, tf, len) of counted rows."""
    return rows.select("unit_key", "len", F.explode("hits").alias("h")).select("unit_key", "h.word", "h.tf", "len")


def counted(tokens: DataFrame) -> DataFrame:
    return postings(counted_rows(tokens))


def totals(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count(F.lit(1)).alias("units"), F.sum("len").alias("words"), F.avg("len").alias("avg_len"))


def text_statistics(units: DataFrame, key: str = "unit_key", text: str = "text") -> TextStatistics:
    # settled: an explode would else copy the tokeniser into a filter above the scan
    tokens = units.select(F.col(key).alias("unit_key"), settled(words(F.col(text))).alias("words"))
    tokens = tokens.select("unit_key", F.size("words").alias("len"), "words")
    return TextStatistics(tokens, totals(tokens))


def asked_words(queries: DataFrame) -> list[str] | None:
    """The distinct words of all queries; None where there are more than `ASKED`."""
    found = query_words(queries).select("word").distinct().limit(ASKED + 1).collect()
    return None if len(found) > ASKED else sorted(r["word"] for r in found)


def asked_statistics(units: DataFrame, queries: DataFrame, text: str = "text") -> TextStatistics:
    """What a batch of queries needs to know of the units, from one pass over their texts.

    No word that is not asked leaves its row. The counted rows are written once; frequencies, scores and
    totals are read from there.
    """
    rows = cut_lineage(counted_texts(units, text, asked_words(queries)), "words")
    return TextStatistics(None, totals(rows), postings(rows), rows)


def term_weight(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def saturation(
    tf: Column, length: Column, avg: Column, k1: float = K.BM25_K1, b: float = K.BM25_B
) -> Column:
    length = F.when(length == 0, F.lit(1)).otherwise(length)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, word): the distinct search words of every query."""
    return queries.select(
        "query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")
    )


def bm25_scores(stats: TextStatistics, queries: DataFrame) -> DataFrame:
    """(query_id, unit_key, score) for every unit that shares a word with the query.

    Only words that occur in a query are exchanged. While the counted query words fit into a
    broadcast, they are picked out where the text (or the stored count) is read. Beyond the bound the
    word join is shuffled with hot words salted.
    """
    wanted = query_words(queries)
    small = fits(wanted)
    distinct = wanted.select("word").distinct()
    tf = stats.term_frequency_of(distinct, small)
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weights = wanted.join(df, "word").select(
        "query_id",
        "word",
        term_weight(stats.totals.select("units").scalar(), F.col("df")).alias("weight"),
    )
    matched = (
        tf.join(F.broadcast(weights), "word") if small else salted_join(tf, weights, ["word"])
    )
    avg = stats.totals.select("avg_len").scalar()
    part = F.col("weight") * saturation(F.col("tf"), F.col("len"), avg)
    return (
        matched.select("query_id", "unit_key", part.alias("part"))
        .groupBy("query_id", "unit_key")
        .agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
    )


def top_per_query(scores: DataFrame, k: int = K.PER_WAY) -> DataFrame:
    """Best k units per query with their rank: score descending, unit key ascending."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("unit_key"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_top(stats: TextStatistics, queries: DataFrame, k: int = K.PER_WAY) -> DataFrame:
    """Best k units per query with their rank.

    Where the words of a unit stand in one row and the queries are few, each task scores its units and hands on k a
    query; else scores are exchanged.
    """
    if stats.rows is not None:
        row = stats.totals.first()
        df = stats.stored.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        weights = query_words(queries).join(df, "word").select("query_id", F.col("word").alias("token"), term_weight(F.lit(row["units"]), F.col("df")).alias("weight"))
        asked, avg = few(weights), F.lit(row["avg_len"] or 1.0)
        if asked is not None:
            value = lambda h: saturation(h["tf"], F.col("len"), avg)
            items = F.transform("hits", lambda h: F.struct(h["word"].alias("token"), value(h).alias("value")))
            q_type = queries.schema["query_id"].dataType.simpleString()
            return top_per_query(listed_scores(stats.rows.select("unit_key", items.alias("items")), asked, q_type, k, SCORE_DIGITS), k)
    return top_per_query(bm25_scores(stats, queries), k)


def bm25_search(units: DataFrame, queries: DataFrame, k: int = K.PER_WAY) -> DataFrame:
    return bm25_top(asked_statistics(units, queries), queries, k)
