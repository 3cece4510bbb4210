"""Rule classification of a table of descriptions in staged projections (no shuffle)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.attributes import filled_count
from statuta.functions.phrases import (
    all_true,
    carrier_action,
    literal_hit,
    phrase_hit,
    required_wording,
    strong_hit,
)
from statuta.functions.text import settled
from statuta.operators.duties import duty_array, privacy_array
from statuta.operators.features import SAFETY, derived, value, with_features
from statuta.operators.rulebook import AreaRule, Prohibition, RuleBook, TransparencyRule

HINT = "struct<class:string,rule:string,certainty:string,basis:array<string>,reason:string>"
PURPOSES = "map<string,struct<value:double,key:string,purpose:string,sentence:string>>"
CHECK = "zu_pruefen"
LIKELY = "wahrscheinlich"


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _strings(items: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def _purpose(rule: str) -> Column:
    return F.try_element_at(F.col("_purposes"), F.lit(rule))


def prepend_basis(key: Column, basis: Column) -> Column:
    """The key in front of the legal bases unless it is already among them."""
    return F.when(key.isNull() | F.array_contains(basis, key), basis).otherwise(
        F.concat(F.array(key), basis)
    )


def hint(
    klass: str, rule: str, certainty: Column | str, basis: tuple[str, ...], reason: str, by_purpose: bool = True
) -> Column:
    own = F.lit(reason)
    legal = _strings(basis)
    if by_purpose:
        found = _purpose(rule)
        own = F.concat_ws(
            " ",
            own,
            F.when(
                found.isNotNull(),
                F.concat(found["sentence"], F.lit(" ~ "), found["purpose"], F.lit(" ("), F.format_number(found["value"], 2), F.lit(")")),
            ),
        )
        legal = prepend_basis(found["key"], legal)
    return F.struct(
        F.lit(klass).alias("class"),
        F.lit(rule).alias("rule"),
        (F.lit(certainty) if isinstance(certainty, str) else certainty).alias("certainty"),
        legal.alias("basis"),
        own.alias("reason"),
    )


def _collect(hints: list[Column]) -> Column:
    if not hints:
        return F.array().cast(f"array<{HINT}>")
    return F.array_compact(F.array(*hints)).cast(f"array<{HINT}>")


def _prohibition(rule: Prohibition) -> Column:
    by_purpose = _purpose(rule.id).isNotNull()
    applies = (all_true(value(f) for f in rule.fields) | by_purpose) & required_wording(
        F.col("_t2"), rule.required
    )
    from_text = _any([derived(f) for f in rule.fields]) | by_purpose
    banned = hint("verboten", rule.id, F.when(from_text, CHECK).otherwise(rule.certainty), rule.basis, rule.reason)
    if not rule.exception:
        return F.when(applies, banned)
    eased = hint(
        "hochrisiko_anhang_iii",
        rule.id + "-ausnahme",
        CHECK,
        (*rule.basis, "KI-VO/anh-III/nr-1"),
        rule.exception,
        by_purpose=False,
    )
    return F.when(applies & derived(SAFETY), eased).when(applies, banned)


def _product(book: RuleBook) -> Column:
    rule = book.product
    if rule is None:
        return F.lit(None).cast(HINT)
    sure = all_true(value(f) for f in rule.fields)
    named = phrase_hit(F.col("_t3"), rule.phrases) & F.coalesce(value(rule.carrier_field), F.lit(False))
    certainty = F.when(sure, LIKELY).otherwise(CHECK)
    return F.when(
        sure | named | _purpose(rule.id).isNotNull(),
        hint("hochrisiko_anhang_i", rule.id, certainty, rule.basis, rule.reason),
    )


def area_words(rule: AreaRule) -> Column:
    """The area is hit by a strong word, a phrase, or a carrier with an action."""
    text = F.col("_t4")
    return (
        strong_hit(text, rule.strong)
        | phrase_hit(text, rule.phrases)
        | carrier_action(text, rule.carriers, rule.actions)
    )


def no_influence(book: RuleBook) -> Column:
    words = book.exception.no_influence if book.exception else ()
    return phrase_hit(F.col("_t2"), words)


def _area(rule: AreaRule) -> Column:
    by_words = area_words(rule)
    by_purpose = _purpose(rule.id).isNotNull()
    applies = (by_words | (by_purpose & ~F.col("_no_influence"))) & ~F.col("_relieved")
    return F.when(applies, hint("hochrisiko_anhang_iii", rule.id, CHECK, rule.basis, rule.title))


def _exception(book: RuleBook) -> Column:
    rule = book.exception
    if rule is None:
        return F.lit(None).cast(HINT)
    decides = F.coalesce(value(rule.counter_field), F.lit(False))
    case = F.coalesce(
        *[F.when(phrase_hit(F.col("_t3"), words), F.lit(name)) for name, words in rule.cases.items()],
        F.lit(None).cast("string"),
    )
    counter = hint(
        "hochrisiko_anhang_iii", rule.counter_id, LIKELY, rule.counter_basis, rule.counter_reason, False
    )
    eased = hint("hochrisiko_ausnahme", rule.id, CHECK, rule.basis, rule.reason, False)
    eased = eased.withField("reason", F.concat_ws(" ", case, F.lit(rule.reason)))
    return (
        F.when(F.size("_areas") == 0, F.lit(None).cast(HINT))
        .when(decides & ~F.col("_no_influence"), counter.cast(HINT))
        .when(case.isNotNull() & F.col("_no_influence"), eased.cast(HINT))
    )


def _transparency(rule: TransparencyRule) -> Column:
    by_purpose = _purpose(rule.id).isNotNull()
    met = all_true(value(f) for f in rule.fields)
    for alternative in rule.any_of_fields:
        met = met | all_true(value(f) for f in alternative)
    from_text = _any([derived(f) for f in rule.fields]) | by_purpose
    applies = met | by_purpose
    if rule.roles:
        applies = applies & ((F.size("roles") == 0) | F.arrays_overlap("roles", _strings(rule.roles)))
    certainty = F.when(from_text, CHECK).otherwise(LIKELY)
    return F.when(applies, hint("transparenz", rule.id, certainty, rule.basis, rule.reason))


def _model(book: RuleBook) -> list[Column]:
    rule = book.model
    if rule is None:
        return []
    only_deployer = F.array_contains("roles", "betreiber") & ~F.array_contains("roles", "anbieter")
    applies = (
        (all_true(value(f) for f in rule.fields) | _purpose(rule.id).isNotNull())
        & ~literal_hit(F.col("_t2"), rule.relief)
        & ~only_deployer
    )
    systemic = applies & F.coalesce(F.col("rechenaufwand_flop") >= rule.threshold, F.lit(False))
    return [
        F.when(applies, hint("gpai", rule.id, LIKELY, rule.basis, rule.reason)),
        F.when(
            systemic,
            hint("gpai_systemisch", rule.systemic_id, LIKELY, rule.systemic_basis, "Trainingsaufwand", False),
        ),
    ]


def hints(descriptions: DataFrame, book: RuleBook, purposes: DataFrame | None = None, key: str = "desc_id") -> DataFrame:
    """Descriptions with `hints`: every rule that fires, with class, certainty and legal bases.

    Stages are separate projections so that folded texts, features and the guards are computed once
    per row. A prohibition, even a downgraded one, suppresses everything after it.
    """
    staged = with_features(descriptions, book)
    if purposes is not None:
        staged = staged.join(purposes.select(key, F.col("purposes").alias("_purposes")), key, "left")
    else:
        staged = staged.withColumn("_purposes", F.lit(None).cast(PURPOSES))
    staged = staged.select(
        "*",
        settled(_collect([_prohibition(p) for p in book.prohibitions])).alias("_bans"),
        no_influence(book).alias("_no_influence"),
        literal_hit(F.col("_t4"), book.area_relief).alias("_relieved"),
    )
    staged = staged.select(
        "*",
        F.when(F.size("_bans") == 0, _collect([_area(a) for a in book.areas])).alias("_areas"),
        F.when(F.size("_bans") == 0, _product(book)).alias("_product"),
        F.when(F.size("_bans") == 0, _collect([_transparency(t) for t in book.transparency])).alias("_transparency"),
        F.when(F.size("_bans") == 0, _collect(_model(book))).alias("_model"),
    )
    staged = staged.withColumn("_exception", F.when(F.size("_bans") == 0, _exception(book)))
    none = F.array().cast(f"array<{HINT}>")
    one = lambda c: F.array_compact(F.array(F.col(c).cast(HINT)))
    later = F.concat(replace_class(F.concat(one("_product"), F.col("_areas")), F.col("_exception")),
                     one("_exception"), F.col("_transparency"), F.col("_model"))
    found = F.when(F.size("_bans") > 0, F.col("_bans")).otherwise(F.coalesce(later, none))
    staged = staged.withColumn("_found", settled(found))
    minimal = hint("minimal", book.minimal_id, LIKELY, book.minimal_basis, book.minimal_reason, False)
    return staged.withColumn(
        "hints",
        settled(F.when(F.size("_found") == 0, F.array(minimal.cast(HINT))).otherwise(F.col("_found"))),
    )


def replace_class(hint_array: Column, exception: Column) -> Column:
    """An applying exception takes the place of all area hints."""
    replaced = F.filter(hint_array, lambda h: h["class"] != "hochrisiko_anhang_iii")
    applies = F.coalesce(exception["class"] == "hochrisiko_ausnahme", F.lit(False))
    return F.when(applies, replaced).otherwise(hint_array)


def rank_of(klass: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in K.RISK_RANK.items() for x in pair])
    return ranks[klass]


def sorted_classes(hint_array: Column) -> Column:
    """Distinct classes, heaviest first."""
    ranked = F.array_sort(
        F.array_distinct(
            F.transform(
                hint_array,
                lambda h: F.struct(rank_of(h["class"]).alias("rank"), h["class"].alias("class")),
            )
        )
    )
    return F.transform(ranked, lambda s: s["class"])


OPEN_QUESTIONS = {
    "rolle": "Rolle angeben: Anbieter oder Betreiber?",
    "personenbezug": "Werden personenbezogene Daten verarbeitet?",
    "kontrolle": "Prüft ein Mensch das Ergebnis, bevor es wirkt?",
    "profiling": "Werden einzelne Menschen bewertet oder eingestuft?",
    "rechenaufwand": "Wie hoch war der Rechenaufwand des Trainings?",
    "duenn": "Die Beschreibung nennt zu wenig; Zweck, Bereich und Betroffene ergänzen.",
}


def open_questions(columns: list[str]) -> Column:
    """Codes of what is still to be asked."""
    high = F.array_contains("classes", "hochrisiko_anhang_iii")
    tests = {
        "rolle": F.size("roles") == 0,
        "personenbezug": value("verarbeitet_personenbezogene_daten").isNull(),
        "kontrolle": high & value("menschliche_kontrolle").isNull(),
        "profiling": high & value("trifft_entscheidungen_ueber_menschen").isNull(),
        "rechenaufwand": F.array_contains("classes", "gpai") & F.col("rechenaufwand_flop").isNull(),
        "duenn": filled_count(columns) < 3,
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()]))


def classify(
    descriptions: DataFrame, book: RuleBook, purposes: DataFrame | None = None, key: str = "desc_id"
) -> DataFrame:
    """One row per description: classes, hints, roles, duties, privacy sections, open questions."""
    fields = [c for c in descriptions.columns if c != key]
    staged = hints(descriptions, book, purposes, key)
    staged = staged.select(
        "*",
        settled(sorted_classes(F.col("hints"))).alias("classes"),
        F.when(F.size("roles") == 0, _strings(K.DEFAULT_ROLES))
        .otherwise(F.col("roles"))
        .alias("effective_roles"),
    )
    return staged.select(
        key,
        "classes",
        F.element_at("classes", 1).alias("heaviest"),
        "hints",
        F.array_sort("roles").alias("roles"),
        "effective_roles",
        settled(duty_array(book)).alias("duties"),
        settled(privacy_array(book)).alias("privacy"),
        settled(open_questions(fields)).alias("open_questions"),
        F.lit(book.as_of).cast("date").alias("as_of"),
    )
