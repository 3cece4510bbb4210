"""SimHash near-duplicates found through deletion-variant signatures.

Two 64-bit fingerprints with at most three different bits, cut into two halves, have one half with at most
one different bit. Each half is therefore indexed 32 times, each time with another bit masked out: halves
that differ in one bit agree where that bit is masked. Fingerprints that meet under a key are compared
whole. Equal fingerprints are one entry of the index, so copies cost nothing beyond their own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.components import components
from statuta.operators.scale import lookup_join
from statuta.session import cut_lineage

WORDS = 3
SEED = 42
DISTANCE = 3
#: A key that more fingerprints share is split by the masked quarters of the other half.
HOT_ROWS = 8192
#: One fingerprint in so many is looked at to find such keys; either way every pair is compared.
PROBE = 16
SMALL_RUN = 16


def fingerprint(text: str | None) -> int:
    """Bits set in over half of the shingles' XXH64 values; zero for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and blanks are \x20 and \x09-\x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(three), SEED) for three in zip(words, words[1:], words[2:])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp BIGINT) for every row; null texts count as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_words"))
    return rows.mapInArrow(hashed, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp BIGINT")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 rows a fingerprint, one for each half and masked bit."""
    half = F.when(F.col("at") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(
        F.shiftrightunsigned("fp", 32)
    )
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at")).select(
        (F.col("at").cast("long") * F.lit(1 << 32))
        .bitwiseOR(half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, at % 32)"))))
        .alias("key"),
        "fp",
    )


def _split_hot(index: DataFrame, hot_rows: int, probe: int) -> DataFrame:
    """(key, sub, fp): entries under a crowded key get one row for each masked quarter of the other half.

    Fingerprints under one key differ by at most three bits in the other half if they are close at all, so
    one of its two quarters differs by at most one bit, and the same argument holds once more.
    """
    seen = index.where(F.pmod(F.xxhash64("fp"), F.lit(probe)) == 0)
    hot = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows / probe)
    hot = cut_lineage(hot.select("key", F.lit(True).alias("hot")), "hot")
    if hot.isEmpty():
        return index.select("key", F.lit(-1).cast("long").alias("sub"), "fp")
    other = F.when(F.col("key") < (32 << 32), F.shiftrightunsigned("fp", 32)).otherwise(
        F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    )
    places = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(31))).otherwise(F.array(F.lit(-1)))
    quarter = F.when(F.col("at") < 16, F.col("other").bitwiseAND(F.lit(0xFFFF))).otherwise(
        F.shiftright("other", 16)
    )
    masked = quarter.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, pmod(at, 16))")))
    return (
        lookup_join(index, hot, ["key"], "left")
        .select("key", "fp", other.alias("other"), F.explode(places).alias("at"))
        .select(
            "key",
            F.when(F.col("at") < 0, F.lit(-1)).otherwise(F.col("at") * 65536 + masked).cast("long").alias("sub"),
            "fp",
        )
    )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, over links within one run."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _run_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one crowded run as stars: compared in blocks, only a spanning set leaves."""
    fp = np.unique(fp)
    found = []
    for i in range(0, len(fp), 2048):
        for j in range(i, len(fp), 2048):
            close = np.bitwise_count(fp[i : i + 2048, None] ^ fp[None, j : j + 2048]) <= distance
            a, b = np.nonzero(close)
            keep = a + i < b + j
            found.append((a[keep] + i, b[keep] + j))
    a, b = (np.concatenate(x) for x in zip(*found))
    root = _roots(len(fp), a, b)
    tied = np.nonzero(root != np.arange(len(fp)))[0]
    return fp[tied], fp[root[tied]]


def _links_of(key: np.ndarray, sub: np.ndarray, fp: np.ndarray, distance: int):
    """Links among the entries of whole keys, given in order of their keys."""
    start = np.nonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])[0]
    size = np.diff(np.r_[start, len(key)])
    run = np.repeat(np.arange(len(start)), size)
    small = size[run] <= SMALL_RUN
    for step in range(1, SMALL_RUN):
        at = np.nonzero((run[step:] == run[:-step]) & small[step:])[0]
        if not len(at):
            break
        a, b = fp[at], fp[at + step]
        close = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        yield a[close], b[close]
    for r in np.nonzero(size > SMALL_RUN)[0]:
        yield _run_links(fp[start[r] : start[r] + size[r]], distance)


def links(fps: DataFrame, distance: int = DISTANCE, hot_rows: int = HOT_ROWS, probe: int = PROBE) -> DataFrame:
    """(a, b): links among distinct fingerprints that span every group of close ones."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_end(batches):
            if batch is not None:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                cut = len(last) - int(last.sum())  # the last key may go on in the next batch
            elif held is None:
                return
            else:
                cut = len(held[0])
            if cut:
                for a, b in _links_of(*(x[:cut] for x in held), distance):
                    if len(a):
                        a, b = a.view(np.int64), b.view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
                        )
                held = [x[cut:] for x in held]

    keyed = _split_hot(variants(fps), hot_rows, probe)
    ordered = keyed.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return ordered.mapInArrow(compared, "a BIGINT, b BIGINT").distinct()


def _then_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS, probe: int = PROBE
) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    `component_id` is the smallest id reachable over links of at most three bits. Null and empty texts have
    fingerprint zero and are linked like any other. Repeated rows each come back; a null id is kept and gets
    the smallest id of its group that is not null (null if there is none). An empty table gives an empty
    result; columns other than the two named ones are not read.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = cut_lineage(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    roots = components(links(classes.select("fp"), hot_rows=hot_rows, probe=probe))
    grouped = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(grouped.join(smallest, "root").select("fp", "component_id"), "named")
    return lookup_join(rows, named, ["fp"]).select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: of the smallest id, and of its texts one.

    A row is told by id and text, so rows of one id whose texts are unlike are groups of their own and all
    stay. Rows without an id are grouped like others and stay only where no row of their group has one. Of
    rows alike in id and text any one stays. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("text")
    )
    kept = near_duplicates(docs.select(key.alias("_key"), text.alias("_text")), "_key", "_text")
    kept = kept.where("_key = component_id").select("_key").distinct()
    rows = docs.select(key.alias("_key"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
