from pyspark.sql import functions as F

from statuta.operators import corpus, quality
from statuta.operators import units as U
from statuta.sources import pages as P
from statuta.sources.articles import article_rows

LONG = "ein Text, der lang genug ist, um als eigene Stelle zu gelten, mit Rest"


def cell(label, text):
    return f"<table><tr><td></td><td>{label}</td><td>{text}</td></tr></table>"


PAGE = f"""<html><body><script>var x = '<p>';</script><div id="cpt_I"><p class="oj-ti-section-1">KAPITEL I</p>
<div id="art_5"><p class="oj-sti-art">Verbote</p>
<div id="005.001"><p>(1) Verboten ist {LONG}</p>{cell("a)", LONG + " A")}{cell("b)", LONG + " B")}{cell("a)", LONG + " C")}{cell("c)", "kurz")}</div>
<div id="005.002">(2) kurz</div><div id="107.004">(4) fremder {LONG}</div></div></div>
<div id="art_3"><p class="eli-title">Begriffe</p>{f'<table><tr><td>1.</td><td>{LONG}</td></tr></table>'}</div>
<div id="anx_III"><p class="oj-doc-ti">ANHANG III</p><p class="oj-doc-ti">Bereiche</p><p class="oj-ti-grseq-1">Abschnitt A</p>
{cell("1.", LONG + cell("a)", LONG))}<p class="oj-ti-grseq-1">anders</p>{cell("2.", LONG)}</div>
<div id="rct_60">(60) {LONG}</div></body></html>"""


def test_units_of_a_structured_page(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    got = {r["unit_key"]: r for r in U.regulation_units(P.node_table(pages), "KI-VO").collect()}
    assert set(got) == {
        "KI-VO/art-5", "KI-VO/art-5/abs-1", "KI-VO/art-5/abs-1-a", "KI-VO/art-5/abs-1-b", "KI-VO/art-5/abs-1-ua2-a",
        "KI-VO/art-3", "KI-VO/art-3/nr-1", "KI-VO/anh-III", "KI-VO/anh-III/nr-A-1", "KI-VO/anh-III/nr-A-1-a",
        "KI-VO/anh-III/nr-A-2", "KI-VO/erw-60",
    }
    assert got["KI-VO/art-5"]["chapter"] == "KAPITEL I" and got["KI-VO/art-5"]["title"] == "Verbote"
    assert got["KI-VO/art-5/abs-1-ua2-a"]["text"] == LONG + " C"
    assert got["KI-VO/art-5"]["text"].endswith("\n\n(2) kurz")
    assert got["KI-VO/art-3/nr-1"]["paragraph"] == "Nummer 1"
    assert got["KI-VO/anh-III"]["title"] == "Bereiche"
    assert got["KI-VO/erw-60"]["text"] == LONG


def test_statute_keeps_the_chapter_over_a_new_part(spark):
    norm = lambda name, title, body="": f'<div class="jnnorm"><span class="jnenbez">{name}</span><span class="jnentitel">{title}</span>{body}</div>'
    html = norm("Teil 1", "A") + norm("Kapitel 1", "K") + norm("Teil 2", "B") + norm("§ 26a", "Daten", f'<div class="jnhtml"><div class="jurAbsatz">(1) {LONG}</div></div>')
    got = U.statute_units(P.node_table(spark.createDataFrame([(1, html)], "page_id long, html string"))).orderBy("unit_key").collect()
    assert [(r["unit_key"], r["chapter"], r["section"]) for r in got] == [
        ("BDSG/par-26a", "Teil 2 B", "Kapitel 1 K"), ("BDSG/par-26a/abs-1", "Teil 2 B", "Kapitel 1 K")]


def test_nested_article_json(spark):
    ddl = "einheit string, nummer string, titel string, kapitel string, abschnitt string, text string, quelle string, absaetze array<struct<nummer:string,text:string,buchstaben:array<struct<buchstabe:string,text:string>>>>"
    rows = spark.createDataFrame([("artikel", "7", "T", "", "", LONG, "q", [("1", LONG, [("a", LONG), ("b", "kurz")])]), ("anhang", "II", "T", "", "", f"(1) {LONG}", "q", None)], ddl)
    got = {r["unit_key"] for r in article_rows(rows, "DSGVO").collect()}
    assert got == {"DSGVO/art-7", "DSGVO/art-7/abs-1", "DSGVO/art-7/abs-1-a", "DSGVO/anh-II"}


def test_first_wins_and_duplicates(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 1, "x"), ("l", 2, "x")], "unit_key string, seq int, text string")
    assert sorted((r["unit_key"], r["seq"]) for r in corpus.first_wins(df, "unit_key", "seq").collect()) == [("k", 1), ("l", 1)]
    assert sorted((r["unit_key"], r["same"]) for r in corpus.duplicate_report(df).collect()) == [("k", False), ("l", True)]


def test_fallback_is_all_or_nothing_per_act(spark):
    official = spark.createDataFrame([("A/1", "A")], "unit_key string, act string")
    other = spark.createDataFrame([("A/2", "A"), ("B/1", "B")], "unit_key string, act string")
    assert sorted(r["unit_key"] for r in corpus.with_fallback(official, other).collect()) == ["A/1", "B/1"]


def test_key_forms(spark):
    keys = ["KI-VO/art-6/abs-2-a", "KI-VO/art-3/nr-39", "KI-VO/anh-III/nr-5-a", "BDSG/par-26/abs-1", "fall/x", "KI-VO/art 6", "ohne", "KI-VO/teil-1"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(quality.key_problem(F.col("k")).alias("p"))
    assert [r["p"] for r in df.collect()] == [None] * 5 + ["leerzeichen", "ohne_trenner", "form"]


def test_labels_and_context_take_no_shuffle_of_page_texts(spark):
    nodes = P.node_table(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    for df in (U.table_labels(nodes), U.with_context(nodes)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    kept = {r["tag"] for r in U.unit_nodes(nodes).where("text IS NOT NULL").collect()}
    assert kept.isdisjoint({"tr", "td", "html", "body"})
    assert [(r["label"], r["cells"]) for r in U.table_labels(nodes).orderBy("table_seq").limit(2).collect()] == [("a", 3), ("b", 3)]


def test_the_parser_hands_on_read_nodes_only_and_their_units_are_the_same(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, PAGE.replace("art_5", "art_6").replace("005.", "006.")), (3, None)], "page_id long, html string")
    full, read = P.node_table(pages), P.node_table(pages, wanted=U.may_be_read)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(read.where(U.is_read())) == rows(full.where(U.is_read())) and read.count() < full.count() / 2
    assert read.where("text IS NULL").isEmpty()
    every = U.regulation_units(full, "KI-VO")
    assert rows(U.regulation_units(read, "KI-VO")) == rows(every)
    assert rows(U.first_units(pages, "KI-VO")) == rows(corpus.first_wins(every, "unit_key", "page_id", "ord").select(*U.UNIT_COLUMNS))


def test_texts_of_nodes_are_normalised_as_columns_are(spark):
    from statuta.functions.text import normalise_space

    odd = ["a  b", " \t x", "c‑d\n\n\n\ne", "　f\t\tg ", "h​", "\x85i", "\x1cj", "k\n ​"]
    pages = spark.createDataFrame([(i, f"<p>{a}<b>{b}</b>{a}</p>") for i, (a, b) in enumerate(zip(odd, odd[::-1]))], "page_id long, html string")
    raw = {i: " ".join(t.strip() for t in (a, b, a)) for i, (a, b) in enumerate(zip(odd, odd[::-1]))}
    want = spark.createDataFrame(list(raw.items()), "page_id long, t string").select("page_id", normalise_space(F.col("t")).alias("t"))
    got = {r["page_id"]: r["text"] for r in P.node_table(pages).where("tag = 'p'").collect()}
    assert got == {r["page_id"]: r["t"] for r in want.collect()}
