"""Citations: labels of units, keys named in questions, citations in answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.text import fold

ANY_CITATION = f"(?iu)(?:{K.QUESTION_CITATION})"


def label(
    kind: Column, act: Column, number: Column, paragraph: Column, title: Column
) -> Column:
    """How a unit is cited: cases and guidelines by title, the rest by kind, number and act."""
    name = F.coalesce(F.nullif(title, F.lit("")), number)
    stem = F.concat(
        F.when(kind == K.KIND_ARTICLE, "Artikel ")
        .when(kind == K.KIND_PARAGRAPH, "§ ")
        .when(kind == K.KIND_ANNEX, "Anhang ")
        .when(kind == K.KIND_RECITAL, "Erwägungsgrund ")
        .otherwise(""),
        number,
    )
    part = F.nullif(paragraph, F.lit(""))
    is_number = F.startswith(part, F.lit("Nummer "))
    sub = F.when(is_number, part).otherwise(
        F.concat(F.when(kind == K.KIND_ANNEX, "Nummer ").otherwise("Absatz "), part)
    )
    full = F.concat_ws(" ", stem, sub)
    cited = F.when(
        (kind == K.KIND_RECITAL) & ~F.coalesce(is_number, F.lit(False)),
        F.concat(full, F.lit(" der "), act),
    ).otherwise(F.concat(full, F.lit(" "), act))
    return (
        F.when(kind == K.KIND_CASE, F.concat(F.lit("Anwendungsfall: "), name))
        .when(kind == K.KIND_GUIDE, name)
        .otherwise(cited)
    )


def meant_acts(question: Column) -> Column:
    """Acts an unqualified article number may belong to; both regulations without a hint."""
    flat = F.lower(question)
    chosen = None
    for act, hints in K.ACT_HINTS:
        hit = None
        for hint in hints:
            one = F.contains(flat, F.lit(hint))
            hit = one if hit is None else hit | one
        value = F.array(F.lit(act))
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return chosen.otherwise(F.array(F.lit(K.ACT_AI), F.lit(K.ACT_GDPR)))


def cited_keys(question: Column) -> Column:
    """Keys of all units a question names, in the order they are named."""
    acts = meant_acts(question)
    found = F.regexp_extract_all(question, F.lit(ANY_CITATION), F.lit(0))
    return F.flatten(F.transform(found, lambda piece: _keys(piece, acts)))


def _keys(piece: Column, acts: Column) -> Column:
    def part(pattern: str, source: Column = piece) -> Column:
        return F.nullif(F.regexp_extract(source, "(?iu)" + pattern, 1), F.lit(""))

    article = part(r"^Art(?:ikel)?\.?\s*(\d{1,3})")
    para = part(r"Abs(?:atz)?\.?\s*(\d{1,2})")
    letter = F.lower(part(r"Buchst(?:abe)?\.?\s*([a-z])"))
    statute = part(r"^§\s*(\d{1,3}[a-z]?)")
    annex = part(r"^Anhang\s*([IVXLC]+)")
    point = part(r"(?:Nr\.?|Nummer)\s*(\d{1,2})")
    recital = part(r"^Erw\D*?(\d{1,3})")
    tail = F.concat(
        F.lit("/art-"),
        article,
        F.coalesce(
            F.concat(F.lit("/abs-"), para, F.coalesce(F.concat(F.lit("-"), letter), F.lit(""))),
            F.lit(""),
        ),
    )
    return (
        F.when(article.isNotNull(), F.transform(acts, lambda a: F.concat(a, tail)))
        .when(statute.isNotNull(), F.array(F.concat(F.lit("BDSG/par-"), statute)))
        .when(
            annex.isNotNull(),
            F.array(
                F.concat(
                    F.lit("KI-VO/anh-"),
                    F.upper(annex),
                    F.coalesce(F.concat(F.lit("/nr-"), point), F.lit("")),
                )
            ),
        )
        .when(
            recital.isNotNull(),
            F.transform(acts, lambda a: F.concat(a, F.lit("/erw-"), recital)),
        )
        .otherwise(F.array().cast("array<string>"))
    )


def answer_citations(text: Column) -> Column:
    """Citations in an answer as distinct array<struct<mark, shown>>, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(K.ANSWER_CITATION), F.lit(0))

    def parse(piece: Column) -> Column:
        article = F.nullif(F.regexp_extract(piece, r"^Art\D*(\d{1,3})", 1), F.lit(""))
        statute = F.nullif(F.regexp_extract(piece, r"^§\s*(\d{1,3}[a-z]?)", 1), F.lit(""))
        annex = F.regexp_extract(piece, r"^Anhang\s+([IVXLC]+)", 1)
        return F.struct(
            F.when(article.isNotNull(), F.concat(F.lit("art-"), article))
            .when(statute.isNotNull(), F.concat(F.lit("par-"), statute))
            .otherwise(F.concat(F.lit("anh-"), annex))
            .alias("mark"),
            F.when(article.isNotNull(), F.concat(F.lit("Artikel "), article))
            .when(statute.isNotNull(), F.concat(F.lit("§ "), statute))
            .otherwise(F.concat(F.lit("Anhang "), annex))
            .alias("shown"),
        )

    return F.array_distinct(F.transform(found, parse))


def evidence_marks(unit_key: Column, citation: Column, excerpt: Column) -> Column:
    """Marks an evidence row allows an answer to cite: its key, its stem, citations in its text."""
    text = F.concat(excerpt, F.lit(" "), citation)

    def marks(pattern: str, prefix: str) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
            lambda n: F.concat(F.lit(prefix), n),
        )

    stem = F.array_join(F.slice(F.split(unit_key, "/"), 1, 2), "/")
    return F.array_distinct(
        F.concat(
            F.array(unit_key, stem),
            marks(r"(?:Artikel|Art\.)\s*(\d{1,3})", "art-"),
            marks(r"§\s*(\d{1,3}[a-z]?)", "par-"),
            marks(r"Anhang\s+([IVXLC]+)", "anh-"),
        )
    )


def compute_budget(text: Column) -> Column:
    """Training compute named in a text (2,5 x 10^25, 10²⁵, 1e26, 10 hoch 25), else NULL."""
    flat = fold(text)
    about = None
    for word in K.BUDGET_WORDS:
        one = F.contains(flat, F.lit(word))
        about = one if about is None else about | one
    sup = K.SUPERSCRIPTS
    pattern = (
        r"(?iu)(?:(\d+(?:[.,]\d+)?)\s*(?:x|\*|·|mal)\s*)?(?:10\s*(?:\^|\*\*|hoch\s*)?|1\s*e)\s*"
        rf"([0-9{sup}]{{1,3}})(?=[^0-9]|$)"
    )
    factor = F.coalesce(
        F.replace(
            F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(","), F.lit(".")
        ).cast("double"),
        F.lit(1.0),
    )
    exponent = F.translate(F.regexp_extract(text, pattern, 2), sup, "0123456789").try_cast("int")
    return F.when(about & exponent.between(10, 40), factor * F.pow(F.lit(10.0), exponent))


def roles_from_text(text: Column) -> Column:
    """Provider and deployer phrases → array of zero, one or two roles."""
    flat = fold(text)

    def any_of(phrases: tuple[str, ...]) -> Column:
        return flat.rlike("|".join("\\Q" + p + "\\E" for p in phrases))

    return F.array_compact(
        F.array(
            F.when(any_of(K.PROVIDER_PHRASES), "anbieter"),
            F.when(any_of(K.DEPLOYER_PHRASES), "betreiber"),
        )
    )
