"""SimHash groups against brute force, components against union-find."""

import random
import re

import numpy as np
import xxhash

from statuta.llm import components, simhash

FOLDER = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Root of each place under links of at most three bits."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(spark, rows, **options):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = groups(fps)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in found) == want


def test_groups_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_odd_rows(spark, odd, empty):
    check(spark, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.keep_one(odd).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "5", "6", "None"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "n_tokens", "score"}


def ball(n, seed=1):
    """Fingerprints in a small ball, where one bit more or less links or does not, and a few apart."""
    r = random.Random(seed)
    centre = r.getrandbits(64)
    out = {centre ^ sum(1 << b for b in r.sample(range(64), r.choice((1, 2, 3, 5)))) for _ in range(n)}
    out |= {centre ^ (x & 0xFFF) for x in range(40)} | {r.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    return sorted(out)


def test_every_link_is_spanned_also_under_crowded_keys(spark):
    fps = ball(150)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = groups(fps)
    for options in ({}, {"hot_rows": 4, "probe": 1}):
        links = simhash.links(spark.createDataFrame(signed, "fp long"), **options).collect()
        at = {f[0]: i for i, f in enumerate(signed)}
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = at[a], at[b]
            assert want[a] == want[b]
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(fps))] == want


def test_a_long_run_leaves_as_a_spanning_set():
    fp = np.array(ball(400, 4), np.uint64)
    a, b = simhash._run_links(fp, 3)
    assert len(a) < len(fp)
    assert (np.array([int(x) for x in a]) != np.array([int(x) for x in b])).all()


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5), (300, 301), (301, 300)]
    r.shuffle(links)
    found = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {7: 7} | {x: 7 for x in range(200, 260)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
