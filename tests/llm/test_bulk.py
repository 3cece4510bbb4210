"""Words that are encoded together, and what the driver gets of a sample."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from statuta.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b's", "'ll", "\n", "\n\n", "  ", " ", " ", " ", "\t", "über", "東京", "12", "...", "\x85", "\xa0", "<|endoftext|>", "　", "don't", "x\n", "é", "\U0001f600", "\r\n"]


def test_words_encoded_together_have_the_ids_of_the_library(monkeypatch):
    draw, library = random.Random(3), Tokenizer.from_file(PATH)
    texts = ["".join(draw.choice(BITS) for _ in range(draw.randint(0, 40))) for _ in range(400)] + ["", " "]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    enc = packing.Encoder(PATH)
    for told in (packing.TOLD, 7):
        monkeypatch.setattr(packing, "TOLD", told)
        assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode_all(pa.array(texts), b"")] == want
    assert enc.encode_all(pa.array([], pa.string()), b"") == []


def test_a_plain_text_goes_to_the_engine_in_one_call():
    enc = packing.Encoder(PATH)
    enc.encode_all(pa.array([" ".join(f"word{i}" for i in range(500))]), b"")
    assert len(enc.known) <= 2


def test_the_language_sample_reaches_the_driver_in_few_bytes():
    from statuta.llm import language_id

    batch = pa.RecordBatch.from_arrays([pa.array(["1"]), pa.array(["de"]), pa.array(["Ein kurzer Satz über Katzen"])], names=["id", "lang", "text"])
    found = next(language_id._features(iter([batch])))
    assert found.schema.field("places").type.value_type == pa.int16() and language_id.BUCKETS <= 1 << 15
    assert sorted(found["places"][0].as_py()) == sorted({g for w in "ein kurzer satz über katzen".split() for g in language_id.grams(w)})


def test_the_store_of_words_of_the_language_sample_is_bounded_in_bytes():
    import tracemalloc

    from statuta.llm import language_id

    texts = [" ".join(f"{i * 500 + k:x}bcdefghijklmnopqrst" for k in range(500)) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(["1"] * 300), pa.array(["de"] * 300), pa.array(texts)], names=["id", "lang", "text"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in language_id._features(iter([batch]))) == 300
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 << 20
