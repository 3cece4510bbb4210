"""Sequence files against the tokenizers library: round trip, order, masks, random access."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from statuta.llm import sequence_files as files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


LIBRARY = tokenizers.Tokenizer.from_file(VOCABULARY)
ENCODER = files.Encoder(VOCABULARY)


TRICKY = [
    "It's the DON'T we'll  I'M ’s 'S",
    "naïve Ünïcödé é ́combining a ́b İstanbul ΟΔΟΣ ß ﬁ",
    "12345 6½ ٣٤ 漢字かな交じり文 　 全角",
    "a\x1cb c\x1fd ᠎ e \x85f  g ​h ﻿",
    "x<|endoftext|>y <|startoftext|><|endoftext|> <|ENDOFTEXT|> <|endoftext",
    "😀👩‍👩‍👧 !!! ... $%& \t\n\r\x0b\x0c",
    "w" * 300 + " " + "é" * 200,
    "",
    "   ",
]


@pytest.mark.parametrize("text", TRICKY)
def test_ids_are_the_library_s(text):
    want = [*LIBRARY.encode(text, add_special_tokens=False).ids, 1]
    found = ENCODER.encode_all(pa.array(["", text, "a b"]).slice(1), 1)
    assert np.frombuffer(found[0], ENCODER.kind).tolist() == want and len(found) == 2


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\x1c'sStTAaé\u0301ÀßſŉİıĲ×÷_0²<|>"))))
def test_ids_of_any_text(text):
    want = [*LIBRARY.encode(text, add_special_tokens=False).ids, 1]
    found = ENCODER.encode_all(pa.array(["", text, "a b"]).slice(1), 1)
    assert np.frombuffer(found[0], ENCODER.kind).tolist() == want and len(found) == 2


def expected(rows):
    coded = [(i, [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(np.array(r[1], "<u2").tobytes())))
    out, start = [], 0
    for i, ids in coded:
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out, [x for _, ids in coded for x in ids]


def test_round_trip_over_several_files(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want, _ = expected(rows)
    found = files.stored(odd, VOCABULARY, length=16, sequences=4, file_bytes=4000)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want


def test_random_access_without_copies(spark, odd, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id <> 5 OR doc_id IS NULL").collect()]
    _, flat = expected(rows)
    frame = odd.where("doc_id <> 5 OR doc_id IS NULL")
    told = files.write_sequences(frame, VOCABULARY, str(tmp_path / "out"), length=8, sequences=2, file_bytes=20).orderBy("shard").collect()
    assert len(told) > 1 and sum(t["n_ids"] for t in told) == len(flat)
    at = 0
    for t in told:
        file = files.SequenceFile(t["path"])
        assert len(file) == t["sequences"] == -(-t["n_ids"] // 8)
        got = np.concatenate([file.ids(i)[file.mask(i) == 1] for i in reversed(range(len(file)))][::-1])
        assert got.tolist() == flat[at : at + t["n_ids"]]
        assert all(file.mask(i).all() for i in range(len(file) - 1))
        assert sum(b.num_rows for b in file.documents()) == t["documents"]
        view = file.file.get_batch(0).column("ids").flatten()
        assert np.shares_memory(file.ids(0), view.to_numpy()) and not file.ids(0).flags.writeable
        file.sources[0].seek(0)
        mapped = file.sources[0].read_buffer(file.sources[0].size())
        assert mapped.address <= file.ids(0).ctypes.data < mapped.address + mapped.size
        with pytest.raises(IndexError):
            file.ids(len(file))
        at += t["n_ids"]
        file.close()


def test_hot_rows_are_split_over_files(spark, tmp_path):
    frame = spark.range(400).selectExpr("CAST(7 AS BIGINT) doc_id", "'the same text again' text")
    told = files.write_sequences(frame, VOCABULARY, str(tmp_path / "hot"), length=8, sequences=2, file_bytes=1000).collect()
    assert len(told) > 5 and max(t["documents"] for t in told) < 120
    starts = sorted(r["start"] for r in files.read_documents(spark.createDataFrame(told)).collect())
    assert starts == list(range(0, 2000, 5))


def test_empty_table(spark, empty):
    assert files.stored(empty, VOCABULARY).collect() == []
