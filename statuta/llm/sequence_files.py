"""Token sequences in Arrow files that can be read at any place without copying.

A file holds record batches of two columns of fixed-size lists: `ids`, sequences of equal length, and `mask`, 1
where a place holds an id and 0 where it is padding. All batches but the last have the same number of
sequences, so sequence i of a file is found by a division, and its ids are a view of the mapped file. The
ids of a file's documents follow one another through its sequences; only its last sequence is padded. A
second file beside it tells where each document starts.

Files are written by the tasks under names of their own; the manifest, which Spark commits, says which ones
count. A task that is run again or twice leaves a file that nobody reads.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.words import Memo, byte_letters, distinct_words, gathered, given_back, slices, special_pattern, stretches
from statuta.session import cut_lineage, scratch

LENGTH = 2048
END = 1
#: Sequences in a record batch, and bytes of text that go into a file, about.
SEQUENCES = 256
FILE_BYTES = 32 << 20
DOCUMENTS = 1 << 16
#: Words whose ids are gathered at a time.
GATHER = 1 << 19
MANIFEST = "shard INT, path STRING, documents BIGINT, sequences BIGINT, n_ids BIGINT"
#: Printable ASCII and the Latin letters up to U+017F, without the one whose lower case is two characters.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
#: The vocabulary's split of lower-case text, for plain words: a fixed value.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w]|_)+")
#: Characters that end a word for Python but perhaps not for the vocabulary's pattern.
DOUBTFUL = "[\x1c-\x1f\u180e]"


class Encoder:
    """Identifiers by the `tokenizers` library, word by word.

    The vocabulary drops white space and never joins characters over it, so the ids of a word hold wherever
    it stands; words met before come from a bounded store. Words of plain Latin letters, digits and signs go
    straight to the library's merges, all others through its whole chain. Special strings are taken out of
    the text first, as the library does.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.engine = tokenizers.Tokenizer.from_file(path)
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.size = max(*told["model"]["vocab"].values(), *special.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.form = "<%d" + ("H" if self.kind.itemsize == 2 else "I")
        self.special = special_pattern(tuple(special))
        self.odd = "|".join([DOUBTFUL, *map(re.escape, special)])
        self.specials = {t: self.raw([i]) for t, i in special.items()}
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.known = Memo(self.word)

    def raw(self, ids: list[int]) -> bytes:
        return struct.pack(self.form % len(ids), *ids)

    def whole(self, text: str) -> bytes:
        return self.raw(self.engine.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """A word's ids. Plain letters are their own composed form and have one lower-case letter each."""
        if not PLAIN.fullmatch(word):
            return self.whole(word)
        low, merged = word.lower(), self.engine.model.tokenize
        if low.isascii():  # printable bytes stand for themselves in the vocabulary
            pieces = [low] if low.isalpha() else PIECES.findall(low)
        else:
            pieces = [p.encode().decode("latin-1").translate(self.letters) for p in PIECES.findall(low)]
        return self.raw([t.id for p in pieces for t in merged(p)])

    def encode(self, text: str) -> bytes:
        """The ids of one text that holds special strings or doubtful characters."""
        found, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            found += [self.whole(text[at : m.start()]), self.specials[m[0]]]
            at = m.end()
        return b"".join([*found, self.whole(text[at:])])

    def encode_all(self, texts: pa.Array, end: int) -> list[bytes]:
        return [ids for part in slices(texts) for ids in self.encode_part(part, end)]

    def encode_part(self, texts: pa.Array, end: int) -> list[bytes]:
        """The ids of every text with `end` behind them.

        The distinct words of all texts are looked up once; the ids of the texts are gathered from theirs.
        """
        odd = pc.match_substring_regex(texts, self.odd)
        words, index, places = distinct_words(pc.if_else(odd, "", texts))
        coded = [self.known[w] for w in words]
        size = np.array([len(c) for c in coded], np.int64) // self.kind.itemsize
        begin, ids = np.cumsum(size) - size, np.frombuffer(b"".join(coded), self.kind)
        last, out = self.raw([end]), []
        for lo, hi in stretches(places, GATHER):
            at = index[places[lo] : places[hi]]
            flat = ids[gathered(begin[at], size[at])]
            cuts = np.r_[0, np.cumsum(size[at])][places[lo : hi + 1] - places[lo]].tolist()
            out += [flat[a:b].tobytes() + last for a, b in zip(cuts, cuts[1:])]
        for i in np.nonzero(odd.to_numpy(zero_copy_only=False))[0].tolist():
            out[i] = self.encode(texts[i].as_py()) + last
        return out


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


class Writer:
    """One file of sequences and the file of its documents, batch by batch."""

    def __init__(self, path: str, kind: np.dtype, id_type: pa.DataType, length: int, sequences: int):
        self.path = path
        files, at = _place(path)
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.kind, self.length, self.room = kind, length, length * sequences
        number = pa.from_numpy_dtype(kind)
        about = {"length": str(length), "sequences": str(sequences)}
        self.schema = pa.schema([("ids", pa.list_(number, length)), ("mask", pa.list_(pa.uint8(), length))], metadata=about)
        self.listed = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n", pa.int64())])
        self.sinks = files.open_output_stream(f"{at}.arrow"), files.open_output_stream(f"{at}.documents.arrow")
        self.out = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], self.listed)
        self.held: list[np.ndarray] = []
        self.waiting = self.n_ids = self.sequences = self.documents = 0

    def add(self, ids: pa.Array, texts: list[bytes]) -> None:
        sizes = np.array([len(t) // self.kind.itemsize for t in texts], np.int64)
        start = self.n_ids + np.cumsum(sizes) - sizes
        for lo in range(0, len(sizes), DOCUMENTS):
            part = slice(lo, lo + DOCUMENTS)
            self.index.write_batch(pa.RecordBatch.from_arrays([ids[part], pa.array(start[part]), pa.array(sizes[part])], schema=self.listed))
        self.documents += len(sizes)
        self.n_ids += int(sizes.sum())
        for text in texts:
            self.held.append(np.frombuffer(text, self.kind))
            self.waiting += len(self.held[-1])
            if self.waiting >= self.room:
                flat = np.concatenate(self.held)
                whole = len(flat) - len(flat) % self.room
                for at in range(0, whole, self.room):
                    self._write(flat[at : at + self.room], self.room)
                self.held, self.waiting = [flat[whole:].copy()], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = (np.arange(len(flat)) < real).astype(np.uint8)
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.sequences += len(flat) // self.length

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.held)
            padded = np.zeros(math.ceil(len(flat) / self.length) * self.length, self.kind)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        for end in (self.out, self.index, *self.sinks):
            end.close()


class SequenceFile:
    """Random access to the sequences and masks of one file; local files are mapped, nothing is copied."""

    def __init__(self, path: str):
        files, at = _place(path)
        local = isinstance(files, pa.fs.LocalFileSystem)
        self.sources = [pa.memory_map(f) if local else files.open_input_file(f) for f in (f"{at}.arrow", f"{at}.documents.arrow")]
        self.file, self.index = map(pa.ipc.open_file, self.sources)
        about = self.file.schema.metadata
        self.length, self.per_batch = int(about[b"length"]), int(about[b"sequences"])
        self.last: dict[str, tuple[int, np.ndarray]] = {}

    def __len__(self) -> int:
        batches = self.file.num_record_batches
        return (batches - 1) * self.per_batch + self.file.get_batch(batches - 1).num_rows if batches else 0

    def flat(self, column: str, batch: int) -> np.ndarray:
        """All places of a batch as one view."""
        if self.last.get(column, (-1,))[0] != batch:
            self.last[column] = batch, self.file.get_batch(batch).column(column).flatten().to_numpy(zero_copy_only=True)
        return self.last[column][1]

    def _one(self, column: str, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = i % self.per_batch * self.length
        return self.flat(column, i // self.per_batch)[at : at + self.length]

    def ids(self, i: int) -> np.ndarray:
        return self._one("ids", i)

    def mask(self, i: int) -> np.ndarray:
        return self._one("mask", i)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from place `start` on, as views of the batches they stand in."""
        room = self.per_batch * self.length
        while n:
            batch, at = divmod(start, room)
            part = self.flat("ids", batch)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        """(doc_id, start, n) of the file's documents."""
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)

    def close(self) -> None:
        for source in self.sources:
            source.close()


def write_sequences(
    docs: DataFrame,
    vocabulary: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end: int = END,
    sequences: int = SEQUENCES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes the ids of all documents by ascending id below `folder`; (shard, path, documents, sequences, n_ids).

    `path` is that of a file without its ending. Files follow one another by shard; each holds a range of
    document ids, of about `file_bytes` bytes of text if texts are of like size. A null or empty text is a
    document of one identifier, `end`; rows without an id come first; rows of one id stand in the order of a
    hash of their text. Rows that are alike are told apart by their place in the input, so they are split
    over files like others. Identifiers take two bytes where the vocabulary allows it. An empty table writes
    nothing. Columns other than the two named ones are not read.

    Texts are shuffled once, by id; a task encodes its range and writes it as it goes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    files = max(1, math.ceil(total / file_bytes))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "hash", "row"]

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc, writer = TaskContext.get().partitionId(), Encoder(vocabulary), None
        for batch in batches:
            if batch.num_rows:
                if writer is None:
                    writer = Writer(f"{folder}/{shard:07d}-{uuid.uuid4().hex}", enc.kind, batch.column(0).type, length, sequences)
                writer.add(batch.column(0), enc.encode_all(batch.column(1), end))
        if writer is None:
            return
        writer.close()
        told = (writer.documents, writer.sequences, writer.n_ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([writer.path]), *(pa.array([x], pa.int64()) for x in told)],
            names=["shard", "path", "documents", "sequences", "n_ids"],
        )

    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return cut_lineage(ranged.mapInArrow(run, MANIFEST), "manifest")


def read_documents(manifest: DataFrame, id_col: str = "doc_id", id_kind: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files; `start` counts over all files.

    The ids of files before one are a running sum over the manifest, one short row for a file. A task reads
    whole files, one batch at a time.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = files.repartitionByRange(max(1, manifest.count()), "shard").select("path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                file = SequenceFile(path)
                for listed in file.documents():
                    crc = []
                    for start, n in zip(listed.column(1).to_pylist(), listed.column(2).to_pylist()):
                        found = 0
                        for part in file.span(start, n):
                            found = zlib.crc32(part.astype("<u4"), found)
                        crc.append(found)
                    start = pa.array(listed.column(1).to_numpy() + base)
                    yield pa.RecordBatch.from_arrays(
                        [listed.column(0), start, listed.column(2), pa.array(crc, pa.int64())],
                        names=[id_col, "start", "n_tokens", "ids_crc32"],
                    )
                file.close()

    return files.mapInArrow(run, f"`{id_col}` {id_kind}, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")


def stored(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """Writes the files to the shared folder and reads the documents back from them."""
    manifest = write_sequences(docs, vocabulary, scratch(docs.sparkSession, "sequences"), id_col, text_col, **how)
    return read_documents(manifest, id_col, docs.schema[id_col].dataType.simpleString())
