"""The ordered index: what it holds, and that a search opens only the parts of its words."""

from collections import Counter

from statuta.operators import bm25
from statuta.plans.search import hybrid_search, indexed, searchable
from statuta.sources import index_io

TEXTS = {f"u{i:03d}": " ".join(f"w{(i * j) % 97:02d}x" for j in range(1, 30)) + (" common" * (i % 3)) for i in range(120)}


def build(spark, path, part):
    units = spark.createDataFrame([(k, "a", "artikel", t) for k, t in TEXTS.items()], "unit_key string, act string, kind string, text string")
    index_io.build_index(spark, units, path, part=part)
    return units, index_io.load_index(spark, path, units, "hashing-256")


def scanned(df, metric):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    found = [leaves.apply(i).metrics().get(metric) for i in range(leaves.size())]
    return sum(m.get().value() for m in found if m.isDefined())


def test_postings_are_the_counts_of_the_texts_in_order(spark, tmp_path):
    _, index = build(spark, str(tmp_path / "index"), 300)
    want = {(k, w): n for k, t in TEXTS.items() for w, n in Counter(t.split()).items()}
    rows = index.tf.collect()
    assert {(r["unit_key"], r["word"]): r["tf"] for r in rows} == want and len(rows) == len(want)
    parts = {}
    for r in rows:
        parts.setdefault(r["part"], []).append((r["word"], r["unit_key"]))
    assert len(parts) > 5
    edges = [(min(p), max(p)) for _, p in sorted(parts.items())]
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    df = Counter(w for _, w in want)
    assert {r["word"]: r["df"] for r in index.df.collect()} == df
    for b in index.blocks.collect():
        held = [u for w, u in parts[b["part"]] if w == b["word"]]
        assert (b["n"], b["first_unit"], b["last_unit"]) == (len(held), min(held), max(held)) and b["impact"] > 0


def test_a_search_reads_the_parts_of_its_words(spark, tmp_path):
    units, index = build(spark, str(tmp_path / "index"), 300)
    all_files, all_rows = scanned(index.postings(None), "numFiles"), scanned(index.postings(None), "numOutputRows")
    some = index.postings(["w05x", "w06x"])
    assert scanned(some, "numFiles") <= 2 < all_files and scanned(some, "numOutputRows") < all_rows / 4
    assert index.postings(["nowhere"]).collect() == []
    queries = spark.createDataFrame([(1, "w05x w06x common"), (2, "w96x"), (3, "nothing")], "query_id long, text string")
    key = lambda df: sorted(map(tuple, df.select("query_id", "unit_key", "score", "rank").collect()))
    stored = bm25.TextStatistics(None, index.totals, index.postings(bm25.asked_words(queries)))
    assert key(bm25.top_per_query(bm25.bm25_scores(stored, queries), 5)) == key(bm25.bm25_search(searchable(units), queries, 5))
    hits = lambda df: sorted((r["query_id"], r["place"], r["unit_key"], r["score"]) for r in df.collect())
    assert hits(hybrid_search(units, queries, **indexed(index, queries))) == hits(hybrid_search(units, queries, **from_live(units, queries)))


def from_live(units, queries):
    from statuta.plans.search import from_texts

    return from_texts(units, queries)


def test_long_lists_of_words_are_joined(spark, tmp_path, monkeypatch):
    _, index = build(spark, str(tmp_path / "index"), 300)
    few = sorted(map(tuple, index.postings(["w05x", "common"]).collect()))
    monkeypatch.setattr(index_io, "IN_PLAN", 1)
    assert sorted(map(tuple, index.postings(["w05x", "common"]).collect())) == few
    monkeypatch.setattr(bm25, "ASKED", 1)
    assert bm25.asked_words(spark.createDataFrame([(1, "ab cd")], "query_id long, text string")) is None


def test_an_empty_corpus_has_an_empty_index(spark, tmp_path):
    units = spark.createDataFrame([], "unit_key string, act string, kind string, text string")
    index_io.build_index(spark, units, str(tmp_path / "index"))
    index = index_io.load_index(spark, str(tmp_path / "index"), units, "hashing-256")
    assert index.postings(["a"]).collect() == [] and index.totals.first()["units"] == 0


def test_no_vector_is_exchanged_and_changed_texts_lose_theirs(spark, tmp_path):
    path = str(tmp_path / "bestand")
    units = spark.range(40).selectExpr("concat('k', id) AS unit_key", "concat('wort', id) AS text")
    index_io.build_index(spark, units, path)
    index = index_io.load_index(spark, path, units, "hashing-256")
    assert "Exchange" not in index.vectors._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert {r["unit_key"] for r in index.vectors.collect()} == {f"k{i}" for i in range(40)}
    changed = units.selectExpr("unit_key", "if(unit_key = 'k7', 'anders', text) AS text")
    index = index_io.load_index(spark, path, changed, "hashing-256")
    assert {r["unit_key"] for r in index.vectors.collect()} == {f"k{i}" for i in range(40) if i != 7}
    index_io.build_index(spark, changed, path)
    index = index_io.load_index(spark, path, changed, "hashing-256")
    assert sorted(r["unit_key"] for r in index.vectors.collect()) == sorted(f"k{i}" for i in range(40))


def test_a_search_on_the_index_scores_rows_and_the_build_leaves_no_texts(spark, tmp_path):
    from statuta.operators.bm25 import bm25_scores, bm25_top
    from statuta.plans.search import indexed

    _, index = build(spark, str(tmp_path / "index"), 300)
    assert not [p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("_")]
    queries = spark.createDataFrame([(1, "common w05x"), (2, "w07x w07x other"), (3, "none")], "query_id long, text string")
    given = indexed(index, queries)
    assert given["statistics"].rows is not None and "items" in given["unit_weights"].columns
    assert given["statistics"].rows.groupBy("unit_key").count().where("count > 1").isEmpty()
    top = {(r["query_id"], r["unit_key"]): r["score"] for r in bm25_top(given["statistics"], queries, 1000).collect()}
    every = bm25_scores(bm25.TextStatistics(None, index.totals, index.postings(None)), queries)
    assert top and top == {(r["query_id"], r["unit_key"]): r["score"] for r in every.collect()}
