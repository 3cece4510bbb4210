import unicodedata

import pytest
from pyspark.sql import functions as F

from statuta.functions import citations, text
from statuta.functions.tokens import words


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_sanitise_drops_hidden_characters_and_composes(spark):
    dirty = "a‮b​c\u0007\tn\n\n\n\nü⁦ ﻿"
    assert one(spark, text.sanitise, dirty) == "abc\tn\n\nü"


def test_normalise_space(spark):
    assert one(spark, text.normalise_space, "Artikel  6 ‑ x\t y\n\n\n\nz ") == "Artikel 6 - x y\n\nz"


@pytest.mark.parametrize("value", ["Größe ÄÖÜ", "café naïve", "ﬁnal ½ ²", "ａｂｃ ①", "plain", "日本 x"])
def test_fold_ascii_equals_compatibility_decomposition(spark, value):
    want = value.lower()
    for old, new in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        want = want.replace(old, new)
    want = unicodedata.normalize("NFKD", want).encode("ascii", "ignore").decode()
    assert one(spark, text.fold_ascii, value) == want


def test_words_count_compound_parts_twice(spark):
    assert one(spark, words, "Das Hochrisiko-KI-System für x") == ["hochrisiko", "ki", "system", "fuer", "hochrisiko", "system"]


def test_redact_keeps_field_names(spark):
    got = one(spark, text.redact, 'api_key = "abcdef123456" Bearer abcdefgh1 http://u:p@h ' + "x" * 50)
    assert "api_key = ⟨Schlüssel entfernt⟩" in got and "abcdef123456" not in got
    assert "abcdefgh1" not in got and "u:p@" not in got and "50 Zeichen" in got


@pytest.mark.parametrize(
    "question,keys",
    [
        ("Was sagt Art. 6 Abs. 3?", ["KI-VO/art-6/abs-3", "DSGVO/art-6/abs-3"]),
        ("Artikel 9 DSGVO", ["DSGVO/art-9"]),
        ("Art. 5 Abs. 1 Buchst. F der KI-VO", ["KI-VO/art-5/abs-1-f"]),
        ("Anhang iii Nummer 4", ["KI-VO/anh-III/nr-4"]),
        ("§ 26 BDSG", ["BDSG/par-26"]),
        ("Erwägungsgrund 60 im AI Act", ["KI-VO/erw-60"]),
        ("Was gilt?", []),
    ],
)
def test_cited_keys(spark, question, keys):
    assert one(spark, citations.cited_keys, question) == keys


@pytest.mark.parametrize(
    "value,flop",
    [("2,5 x 10^25 FLOP", 2.5e25), ("Rechenaufwand 10²⁵", 1e25), ("1e26 flop", 1e26), ("10 hoch 25", None), ("flop 10^99", None)],
)
def test_compute_budget(spark, value, flop):
    got = one(spark, citations.compute_budget, value)
    assert got == pytest.approx(flop) if flop else got is None


def test_sentences_add_purpose_clauses(spark):
    got = one(spark, text.sentences, "Wir verkaufen eine Software, die Bewerbungen sortiert und bewertet. Was gilt dann? Ende.")
    assert got == [
        "Wir verkaufen eine Software, die Bewerbungen sortiert und bewertet.",
        "Ende.",
        "Wir Bewerbungen sortiert und bewertet.",
    ]


def test_only_rhetorical_questions_are_kept(spark):
    assert one(spark, text.sentences, "Was gilt?") == ["Was gilt?"]


def test_boilerplate(spark):
    assert one(spark, text.cut_boilerplate, "(3)\nDSGVO\nText bleibt\n← Art. 5 DSGVO →\nFehler melden weg") == "Text bleibt"


def test_a_derived_sentence_counts_each_time(spark):
    twice = "Das System liest Zeitungen aus aller Welt. Die Software liest Zeitungen aus aller Welt."
    df = spark.createDataFrame([(twice,)], "t string").select(text.sentences(F.col("t")).alias("s"))
    assert df.first()["s"][2:] == ["Wir liest Zeitungen aus aller Welt."] * 2


def test_sentences_of_turns_with_one_id_are_distinct(spark, tmp_path):
    from statuta.registry.text import x14

    rows = [(1, 100, "user", "Wir lesen."), (2, 0, "user", "Wir lesen.")]  # conv_id * 100 + turn is 200 for both
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in x14(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) > 0


def test_the_first_word_of_a_preamble_ends_before_an_umlaut(spark):
    said = "Dieäutz und mehr nicht, die die Schriften aller Welt liest."
    assert one(spark, text.sentences, said) == [said, "Wir die Schriften aller Welt liest."]
