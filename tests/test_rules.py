import pytest
from pyspark.sql import functions as F

from statuta.functions import phrases
from statuta.operators.rulebook import AreaRule, Duty, ExceptionRule, Prohibition, RuleBook
from statuta.plans.classify import classify
from statuta.plans.report import unsupported_citations

BASE = "desc_id long, free_text string, zweck string, einsatzbereich string, nutzergruppe string, roles array<string>, rechenaufwand_flop double, anzahl_beschaeftigte int, markt string, biometrie boolean, trifft_entscheidungen_ueber_menschen boolean"


def described(spark, *rows):
    return spark.createDataFrame([(i, t, "", "", "", roles, None, None, "EU", bio, decides) for i, (t, roles, bio, decides) in enumerate(rows)], BASE)


@pytest.mark.parametrize(
    "fn,text,word,hit",
    [
        (phrases.feature_phrase, "unser sprachmodell lernt", "modell", True),
        (phrases.feature_phrase, "ein notebook", "note", True),
        (phrases.feature_phrase, "die abbildung", "bild", False),
        (phrases.feature_phrase, "xaby", "ab", True),
        (phrases.strong_word, "unser sprachmodell", "modell", False),
        (phrases.strong_word, "die bewerbungen", "Bewerbung", True),
        (phrases.strong_word, "der api zugang", "api", False),
        (phrases.rule_phrase, "note wird automatisch", "note automatisch", True),
        (phrases.rule_phrase, "alles automatisch", "note automatisch", False),
        (phrases.rule_phrase, "die ki", "ki", False),
    ],
)
def test_four_predicates_differ(spark, fn, text, word, hit):
    row = spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"), word).alias("x")).first()
    assert row["x"] is hit


BOOK = RuleBook(
    features={"biometrie": ("gesicht",)},
    safety_exception=("medizin",),
    prohibitions=(Prohibition("v", ("biometrie",), exception="x", basis=("KI-VO/art-5",), certainty="sicher"),),
    areas=(AreaRule("a", "Arbeit", strong=("bewerbung",), basis=("KI-VO/anh-III/nr-4",)),),
    exception=ExceptionRule("h6", cases={"eng": ("sortieren",)}, no_influence=("entscheidet nicht",)),
    duties=(
        Duty("alle", only_if_all=("biometrie",), reservation="vorbehalt"),
        Duty("eng", only_if=("biometrie",), if_unknown="weglassen"),
        Duty("rolle", roles=("betreiber",), classes=("hochrisiko_anhang_iii",)),
    ),
)


def test_classification_paths(spark):
    rows = described(
        spark,
        ("Gesicht erkennen", [], None, None),
        ("Gesicht in der Medizin und Bewerbung", [], None, None),
        ("Gesicht", [], True, None),
        ("Bewerbungen", ["betreiber"], False, None),
        ("Bewerbungen sortieren, entscheidet nicht", ["anbieter"], None, None),
        ("Bewerbungen sortieren, entscheidet nichts", [], None, True),
        ("Bewerbungen", [], None, True),
        ("Wetter", [], None, None),
    )
    got = {r["desc_id"]: r for r in classify(rows, BOOK).collect()}
    rules = {k: [(h["rule"], h["certainty"]) for h in r["hints"]] for k, r in got.items()}
    assert rules[0] == [("v", "zu_pruefen")]
    assert rules[1] == [("v-ausnahme", "zu_pruefen")] and got[1]["classes"] == ["hochrisiko_anhang_iii"]
    assert rules[2] == [("v", "sicher")]
    assert got[3]["classes"] == ["hochrisiko_anhang_iii"]
    assert [d["id"] for d in got[3]["duties"]] == ["rolle"]
    assert rules[4] == [("h6", "zu_pruefen")]
    assert rules[5] == [("h6", "zu_pruefen")]
    assert rules[6] == [("a", "zu_pruefen"), ("h6-3-profiling", "wahrscheinlich")]
    assert got[7]["classes"] == ["minimal"]
    assert [(d["id"], d["reservation"]) for d in got[7]["duties"]] == [("alle", "vorbehalt")]
    assert [d["id"] for d in got[0]["duties"]] == ["alle", "eng"]


def test_citation_check_exact_and_substring(spark):
    answers = spark.createDataFrame([(1, "Siehe Artikel 5 und § 26, Anhang III.")], "answer_id long, text string")
    proof = spark.createDataFrame([(1, "KI-VO/art-50/abs-1", "Artikel 50", "nach Anhang III")], "answer_id long, unit_key string, citation string, excerpt string")
    shown = lambda m: sorted(r["shown"] for r in unsupported_citations(answers, proof, m).collect())
    assert shown("exact") == ["Artikel 5", "§ 26"]
    assert shown("substring") == ["§ 26"]
