"""Secret scans against Python's own patterns, and the power of the randomness tests."""

import base64
import hashlib
import random
import re

from statuta.llm import secret_scan

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_base_spans_equal_the_patterns(spark, odd):
    r = random.Random(5)
    parts = ["token", "=", ":", " ", "'", '"', "ab", "F0", "Secret", "AKIA", "QWERTY123456789ABC", "deadbeef", "😀", "\n", "apikey", "api_key", "ſecret", "K"]
    texts = ["".join(r.choice(parts) for _ in range(40)) for _ in range(300)] + ["x" * 100_000 + " secret=abcdef1", "token:token:abcdefgh", "token=ab", None, ""]
    texts += [x["text"] for x in odd.collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secret_scan.secret_spans(frame).collect():
        want = brute(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), repr(texts[row["doc_id"]])
        kinds = [x.split(":")[0] for x in want.split(",") if x]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [kinds.count(k) for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(row["spans"].split(","))


def test_random_keys_are_found_and_words_are_not(spark):
    r = random.Random(9)
    keys = [base64.b64encode(r.randbytes(30)).decode().rstrip("=") for _ in range(150)]
    keys += ["".join(r.choice("ABCDEF0123456789") for _ in range(40)) for _ in range(100)]
    syllables = "the an tion er in re and on ing st en th at es or ea ti ed ly".split()
    words = ["".join(r.choice(syllables) for _ in range(10)) for _ in range(300)]
    words += ["-".join(r.choice(syllables) for _ in range(12)) + "-2024" for _ in range(100)]
    words += ["some/path/" + "/".join(r.choice(syllables) for _ in range(8)) + "/Index" for _ in range(100)]
    texts = [f"see {x} there" for x in keys + words]
    rows = {x["doc_id"]: x["spans"] for x in secret_scan.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hit = [rows[i] == f"random:4:{4 + len(t) - 10}" for i, t in enumerate(texts)]
    assert sum(hit[: len(keys)]) >= 0.95 * len(keys)
    assert sum(bool(rows[i]) for i in range(len(keys), len(texts))) <= 3


def test_redaction(spark, odd, empty):
    rows = [(1, "a token=abcdef12 b", 18), (2, None, None), (3, "clean", 5), (4, "secret: deadbeefdeadbeefdeadbeefdeadbeef", 40)]
    names = ["_all", "_base", "_run", "_row", "_text", "_clean", "_found", "a.b"]  # the operator's own, and an odd one
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    frame = spark.createDataFrame([(*row, *names) for row in rows], schema)
    got = secret_scan.redacted(frame).orderBy("doc_id").collect()
    wanted = [(1, "a [SECRET] b", 12), (2, None, None), (3, "clean", 5), (4, "[SECRET]", 8)]
    assert [tuple(x) for x in got] == [(*row, *names) for row in wanted] and got[0].__fields__ == frame.columns
    assert secret_scan.redacted(odd).columns == odd.columns and secret_scan.redacted(odd).count() == 8
    assert secret_scan.secret_spans(empty).collect() == []


def test_keys_of_every_alphabet_and_length_also_inside_urls(spark):
    r = random.Random(11)
    alphabets = [a for _, a in secret_scan.ENCODINGS.values() if a not in (secret_scan.DIGITS, secret_scan.DIGITS + "abcdef")]
    alphabets += [secret_scan.DIGITS + "ABCDEF"]
    places = ("{}", "https://host.example.com/v1/user-data/{}", "/var/lib/some_service/{}", "//{}/current-version/readme")
    sizes, cases = (20, 32, 40, 64), []
    for a, n, place in ((a, n, p) for a in alphabets for n in sizes for p in places for _ in range(15)):
        # between slashes a key has no slash; random keys that begin or end a part with a sign lose it there
        letters = a if place == "{}" else a.translate({ord("+"): None, ord("/"): None})
        cases.append((a, place, place.format("".join(r.choice(letters) for _ in range(n))), n))
    texts = [f"see {text} there" for _, _, text, _ in cases]
    rows = {x["doc_id"]: x["spans"] for x in secret_scan.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hits = {}
    for i, (a, place, _, n) in enumerate(cases):
        start = 4 + place.index("{}")
        spans = [tuple(map(int, x.split(":")[1:])) for x in rows[i].split(",") if x]
        hits.setdefault((a, place), []).append(any(s <= start and start + n <= e for s, e in spans))
    assert min(sum(h) / len(h) for h in hits.values()) >= 0.9
    assert sum(map(sum, hits.values())) >= 0.98 * len(cases)


def test_long_words_and_paths_are_not_secrets(spark):
    words = "internationalization Datenschutzgrundverordnung uncharacteristically desafortunadamente anticonstitutionnellement".split()
    words += "src/main/java/org/apache/spark/sql/execution/datasources some-very-long-slug-of-an-article-about-data".split()
    words += "getUserDataFromCacheOrDatabase MAX_NUMBER_OF_CONNECTIONS_PER_HOST 00000000000000000000 --------------------------".split()
    texts = [f"see {x} there" for x in words]
    rows = secret_scan.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [words[x["doc_id"]] for x in rows if x["spans"]] == []
