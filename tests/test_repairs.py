from pyspark.sql import functions as F

from statuta.functions import text
from statuta.operators import bm25, questionnaire as Q, rescore
from statuta.plans.search import searchable
from statuta.registry.demo_survey import SURVEY
from statuta.sources.cases import lessons_from_hits
from statuta.streaming import upkeep

C = Q.Compiled(SURVEY)


def units(spark, *rows):
    return spark.createDataFrame(list(rows), "unit_key string, text string")


def words(spark, path):
    return {r["word"]: r["df"] for r in upkeep.document_frequency(spark, path).collect()}


def test_a_reverted_text_is_live_again(spark, tmp_path):
    path = str(tmp_path / "index")
    for version, content in enumerate(("alpha beta", "gamma", "alpha beta")):
        upkeep.add_units(units(spark, ("u", content)), path, version)
    assert words(spark, path) == {"alpha": 1, "beta": 1}


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "index")
    upkeep.add_units(units(spark, ("u", "alpha"), ("v", "alpha")), path, 0)
    batch = units(spark, ("u", "delta"), ("u", "beta"))
    upkeep.add_units(batch, path, 1)
    once = words(spark, path)
    upkeep.add_units(batch, path, 1)
    assert words(spark, path) == once == {"alpha": 1, "delta": 1}


def test_unicode_blanks_and_letters(spark):
    df = spark.createDataFrame([("  ",), (" a b　",)], "t string")
    got = [tuple(r) for r in df.select(text.strip(F.col("t")).alias("s"), text.length_status(text.sanitise(F.col("t"), compose=False), 10)).collect()]
    assert got == [("", "leer"), ("a b", "ok")]
    line = spark.createDataFrame([("SCHLÜSSEL: geheim12345",)], "t string").select(text.redact(F.col("t"))).first()[0]
    assert "geheim" not in line


def test_cases_without_answers_get_the_first_sheet(spark):
    answers = spark.createDataFrame([(1, "vor:ki", "yes")], "case_id long, question_id string, answer string")
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    sheets = {r["case_id"]: r["sheet"] for r in Q.next_sheet(C.state(answers, cases), C).collect()}
    assert set(sheets) == {1, 2} and len(sheets[2]) > 0


def test_search_finds_words_of_title_and_chapter(spark):
    u = spark.createDataFrame(
        [("k", "DSGVO", "artikel", "5", None, "Grundsatz", "Kapitel", "nur Text")],
        "unit_key string, act string, kind string, number string, paragraph string, title string, chapter string, text string",
    )
    q = spark.createDataFrame([(1, "grundsatz"), (2, "kapitel")], "query_id long, text string")
    found = bm25.bm25_search(searchable(u), q).select("query_id", "unit_key").collect()
    assert {tuple(r) for r in found} == {(1, "k"), (2, "k")}


def test_a_scorer_is_loaded_once_a_worker():
    calls = []

    def load():
        calls.append(1)
        return len

    rescore._scorers.clear()
    one = rescore.loaded(load)
    assert rescore.loaded(load) is one


def test_only_five_cases_of_a_query_are_collected(spark):
    hits = spark.range(40).selectExpr("id DIV 40 + 1 AS query_id", "id AS place", "id AS unit_key")
    cases = spark.range(40).selectExpr(
        "id AS unit_key", "'fallbeispiel' AS kind", "concat('t', id) AS title", "'' AS number", "if(id >= 7, concat('Worauf es ankommt: l', id), '') AS text")
    found = lessons_from_hits(hits, cases)
    assert [tuple(r) for r in found.collect()] == [(1, "l7", ["t0", "t1", "t2", "t3", "t4"])]
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()


def test_case_files_hold_one_case_a_line(spark, tmp_path, monkeypatch):
    from statuta.registry import corpus

    spark.range(300).selectExpr("id AS doc_id", "'src1' AS source", "'de' AS lang", "repeat('x', 1000) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus, "scratch", lambda spark, name: str(tmp_path / name))
    assert corpus.s04(spark, str(tmp_path)).count() == 270
    assert max(r["n"] for r in spark.read.text(str(tmp_path / "faelle")).selectExpr("length(value) AS n").collect()) < 1200
