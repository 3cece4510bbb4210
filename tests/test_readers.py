"""Readers of whole files, on files as they come: several lines, notes, broken ones, arrays."""

import json

from statuta.sources.articles import CONTENTS_FILE, read_articles
from statuta.sources.cases import read_cases
from statuta.sources.corpus_io import read_logs
from statuta.sources.pages import read_pages


def test_a_page_is_one_row_whatever_its_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.html").write_text("<p>one</p>\n<p>two</p>\r\n\n", newline="")
    (tmp_path / "y.html").write_text("é")
    rows = {r["page_id"].rsplit("/", 1)[1]: r for r in read_pages(spark, str(tmp_path)).collect()}
    assert rows["x.html"]["html"] == "<p>one</p>\n<p>two</p>\r\n\n" and rows["x.html"]["bytes"] == 24
    assert rows["y.html"]["bytes"] == 2 and rows["y.html"]["as_of"] is not None and len(rows) == 2


def test_articles_skip_notes_contents_and_broken_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    good = {"einheit": "artikel", "nummer": "1", "text": "t\nu"}
    (tmp_path / "deep" / "a.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "many.json").write_text(json.dumps([good, good], indent=2))
    (tmp_path / "_note.json").write_text(json.dumps(good))
    (tmp_path / CONTENTS_FILE).write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "other.txt").write_text(json.dumps(good))
    assert [r["text"] for r in read_articles(spark, str(tmp_path)).collect()] == ["t\nu"] * 3


def test_cases_and_logs_are_lists_over_several_lines(spark, tmp_path):
    (tmp_path / "c").mkdir()
    cases = {"faelle": [{"kennung": "1", "titel": "T"}, {"titel": "without id"}, {"kennung": "2", "datei": "own"}]}
    (tmp_path / "c" / "f.json").write_text(json.dumps(cases, indent=1))
    found = {r["kennung"]: r["datei"] for r in read_cases(spark, str(tmp_path / "c")).collect()}
    assert set(found) == {"1", "2"} and found["1"].endswith("f.json") and found["2"] == "own"
    logs = []
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"index": i, "soll": name, "ist": "x"} for i in range(n)], indent=1))
        logs.append(str(tmp_path / f"{name}.json"))
    assert sorted((r["index"], r["soll"]) for r in read_logs(spark, logs).collect()) == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "a")]


def test_article_files_hold_up_to_fifty_articles(spark, tmp_path, monkeypatch):
    from statuta.registry import corpus

    spark.range(1000).selectExpr("id AS doc_id", "'s' AS source", "'de' AS lang", "concat('a', char(10), char(34), 'b') AS text").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus, "scratch", lambda spark, name: str(tmp_path / name))
    assert [tuple(r) for r in corpus.s03(spark, str(tmp_path)).collect()] == [(1000, 500)]
    assert len([p for p in (tmp_path / "artikel").rglob("*.txt") if p.is_file()]) == 20
