"""Token counts, packing and language-model scores against libraries and brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statuta.llm import lm_score, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


def library():
    return Tokenizer.from_file(PATH)


def strange(n, seed=3):
    r = random.Random(seed)
    signs = ["a", "b", " ", "  ", "'s", "T", "12", "\n", "\t", "\xa0", "é", "²", "日", "🙂", ".", ",", "\x1c", "<|endoftext|>", "don't", " the", " "]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_counts_and_ids_equal_the_library():
    lib, counter, encoder = library(), token_counts.Counter(PATH), packing.Encoder(PATH)
    for text in [*strange(1500), "a" * 5000, " " * 300 + "x", ""]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(ids), repr(text)
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == ids, repr(text)
        found = encoder.encode_all(pa.array(["q", text, "q r"]).slice(1), b"")[0]
        assert np.frombuffer(found, encoder.kind).tolist() == ids, repr(text)


def test_a_full_store_of_pieces_starts_anew():
    counter = token_counts.Counter(PATH)
    counter.pieces.keep = counter.words.keep = 3
    lib = library()
    for text in strange(60, 8):
        assert counter.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_counts_of_odd_rows(odd, empty):
    rows = token_counts.token_counts(odd, PATH, limit=1024).collect()
    assert len(rows) == 8 and rows[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    by = {r["doc_id"]: r for r in rows}
    assert (by[2]["n_bytes"], by[2]["n_tokens"], by[3]["n_tokens"]) == (0, 0, 0)
    assert by[5]["over_limit"] and not by[1]["over_limit"]
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and None in by
    assert token_counts.token_counts(empty, PATH).collect() == []


def packed_right(rows, texts, window=2048):
    lib = library()
    want = Counter()
    for i, text in texts:
        want[i, zlib.crc32(np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())] += 1
    ids = {}
    for i, text in texts:
        ids[i] = np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, pieces in by_doc.items():
        copies = sum(j == i for j, _ in texts)
        assert sum(p["length"] for p in pieces) == copies * len(ids[i])
        at = Counter()
        for p in pieces:
            part = ids[i][p["start"] : p["start"] + p["length"]]
            assert p["length"] == len(part) > 0 and p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["doc_tokens"] == len(ids[i])
            at.update(range(p["start"], p["start"] + p["length"]))
        assert set(at.values()) == {copies}
    assert by_doc.keys() == {i for i, _ in texts}
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_packing_is_a_partition_of_all_ids(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(150)
    texts = [tuple(r) for r in docs.collect()]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for shard in (2_000_000, 20_000):
        packed_right(packing.pack(frame, PATH, shard_ids=shard).collect(), texts)


def test_packing_of_odd_rows(odd, empty):
    packed_right(packing.pack(odd, PATH).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(empty, PATH).collect() == []


def test_a_seed_gets_its_lexical_neighbour():
    a, b, c = np.array([5, 6, 7, 1]), np.array([50, 51, 52, 1]), np.array([5, 6, 8, 1])
    shard = packing.Shard([a, b, c], np.ones(60), 4.0)
    assert shard.neighbours(0)[0] == 0 and shard.take(0) == 0
    assert shard.neighbours(0)[0] == 2
    order = [p[0] for p in packing.Shard([a, b, c], np.where(np.arange(60) == 1, 0, 1.0), 4.0).pieces(8)]
    assert order[:2] == [0, 2]


def test_all_terms_of_a_seed_count():
    rng = np.random.default_rng(3)
    docs = [rng.choice(400, size=rng.integers(30, 120), p=np.arange(400, 0, -1) / 80200) for _ in range(300)]
    idf = np.log1p(300 / (1 + np.arange(400)[::-1]))
    mean = float(np.mean([len(d) for d in docs]))
    shard = packing.Shard(docs, idf, mean)
    for seed in (0, 7, 299):
        want = np.zeros(300)
        for i, d in enumerate(docs):
            tf = np.bincount(d, minlength=400)
            weight = idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
            want[i] = weight[np.unique(docs[seed])].sum()
        assert np.allclose(shard.scores(seed), want, rtol=1e-5)
        order = shard.neighbours(seed)
        assert len(order) == np.count_nonzero(want) and (np.diff(want[order]) <= 1e-4).all()


def brute_scores(rows, share):
    def tokens(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    uni, bi, n = Counter(), Counter(), 0
    for i, text in rows:
        if not held(i):
            w = tokens(text)
            uni.update(w)
            bi.update(zip(["<s>", *w], w))
            n += 1
    total, kinds = sum(uni.values()), len(uni)
    once, twice = (sum(v == k for v in uni.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    out = []
    for i, text in rows:
        w, before, score, base = tokens(text), "<s>", 0.0, 0.0
        for x in w:
            p = ((uni[x] - d) / total if uni[x] else d * kinds / total) if total else 1.0
            c = n if before == "<s>" else uni[before]
            score += math.log10(share * bi[before, x] / c + (1 - share) * p if c else p)
            base += math.log10((uni[x] + 1) / (total + kinds + 1))
            before = x
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), total, base, score))
    return out


def same(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9)


def test_scores_equal_brute_force(spark, odd, empty):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(120)
    rows = [tuple(r) for r in docs.collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(lm_score.score(frame, block_bytes=40_000).collect(), brute_scores(rows, lm_score.ARC_SHARE))
    same(lm_score.score(odd).collect(), brute_scores([(r["doc_id"], r["text"]) for r in odd.collect()], lm_score.ARC_SHARE))
    assert lm_score.score(empty).collect() == []


def test_probabilities_of_a_history_sum_to_one():
    block = lm_score.Block(["a b a c", "b a", "zz a"], np.array([True, True, False]))
    corpus = lm_score.Corpus(8, 4, 1, 2)
    auto = lm_score.Automaton(block, block.own, corpus, 0.3)
    words = np.nonzero(block.own[: block.n_words] > 0)[0]
    root = 10**auto.root
    start = 0
    known = [w for w in words if w != start]
    unknown = corpus.discount * corpus.kinds / corpus.tokens
    assert math.isclose(sum(root[w] for w in known) + unknown, 1.0, rel_tol=1e-9)
    arcs = {(h, f): a for h, f, a, seen in zip(block.history, block.follower, 10**auto.arc, auto.has_arc) if seen}
    for h in words:
        if not any(k[0] == h for k in arcs):
            continue
        total = sum(arcs.get((h, w), 10 ** auto.failure[h] * root[w]) for w in known) + 10 ** auto.failure[h] * unknown
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rows = lm_score.score(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("held_out")
    base, score = rows.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base
