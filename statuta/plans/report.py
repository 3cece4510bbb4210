"""Answer texts from classifications and evidence, and the check of the citations in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.citations import answer_citations, evidence_marks
from statuta.functions.text import shorten
from statuta.operators.scale import lookup_join
from statuta.plans.classify import OPEN_QUESTIONS

# ---- fixed values: lines of the report ------------------------------------------
HEAD = "Einstufung: "
ROLE = "Rolle: "
WHY = "Warum:"
TO_DO = "Zu tun nach der KI-Verordnung:"
PRIVACY = "Zu tun nach dem Datenschutzrecht:"
MISSING = "Damit die Auskunft genauer wird:"
FOUND = "Die Suche hat folgende Stellen gefunden:"
NOTHING = "Zu dieser Frage wurde im Bestand nichts gefunden."
VALID_FROM = " — gilt ab "


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def _block(title: str, lines: Column, blank: bool = True) -> Column:
    """Heading and lines, nothing when there are no lines."""
    head = [F.lit(""), F.lit(title)] if blank else [F.lit(title)]
    return F.when(F.size(lines) > 0, F.concat(F.array(*head), lines)).otherwise(
        F.array().cast("array<string>")
    )


def _due(duty: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit(VALID_FROM), F.date_format(duty["valid_from"], "yyyy-MM-dd")), F.lit("")
    )


def report_text() -> Column:
    """Report of a classified row (columns of `classify`)."""
    head = F.concat(F.lit(HEAD), _lookup(K.RISK_LABEL, F.col("heaviest")))
    role = F.when(
        F.size("roles") > 0, F.array(F.concat(F.lit(ROLE), F.array_join("roles", ", ")))
    ).otherwise(F.array().cast("array<string>"))
    why = F.transform(
        "hints", lambda h: F.concat(F.lit("- "), h["reason"], F.lit(" ["), h["certainty"], F.lit("]"))
    )
    duties = F.transform(
        "duties",
        lambda d: F.concat(
            F.lit("- "), d["title"], F.lit(" ("), d["citation"], F.lit(")"), _due(d), F.lit("\n  "), d["action"]
        ),
    )
    privacy = F.transform(
        "privacy",
        lambda s: F.concat(F.lit("- "), s["title"], F.lit(" ("), s["citation"], F.lit(")\n  "), s["action"]),
    )
    asked = F.transform("open_questions", lambda q: F.concat(F.lit("- "), _lookup(OPEN_QUESTIONS, q)))
    return F.array_join(
        F.concat(
            F.array(head),
            role,
            F.array(F.lit(""), F.lit(WHY)),
            why,
            _block(TO_DO, duties),
            _block(PRIVACY, privacy),
            _block(MISSING, asked),
        ),
        "\n",
    )


def fact_sheet() -> Column:
    """The classification in the form that is handed to a language model."""
    others = F.slice("classes", F.lit(2), F.greatest(F.size("classes"), F.lit(0)))
    head = F.concat(
        F.lit("Risikoklasse: "), F.col("heaviest"), F.lit(" — "), _lookup(K.RISK_LABEL, F.col("heaviest"))
    )
    more = F.when(
        F.size("classes") > 1,
        F.array(F.concat(F.lit("Weitere zutreffende Klassen: "), F.array_join(others, ", "))),
    ).otherwise(F.array().cast("array<string>"))
    role = F.when(F.size("roles") > 0, F.concat(F.lit(ROLE), F.array_join("roles", ", "))).otherwise(
        "Rolle: nicht angegeben — beide Sichten sind dargestellt"
    )
    why = F.transform(
        "hints",
        lambda h: F.concat(
            F.lit("Begründung ["), h["certainty"], F.lit(", Regel "), h["rule"], F.lit("]: "), h["reason"],
            F.lit(" (Fundstellen: "),
            F.coalesce(F.nullif(F.array_join(h["basis"], ", "), F.lit("")), F.lit("keine")),
            F.lit(")"),
        ),
    )
    duties = F.transform(
        "duties",
        lambda d: F.concat(
            F.lit("  - "), d["title"], F.lit(" ("), d["citation"], F.lit(")"),
            F.coalesce(F.concat(F.lit(" ab "), F.date_format(d["valid_from"], "yyyy-MM-dd")), F.lit("")),
            F.lit(": "), d["action"],
        ),
    )
    privacy = F.transform(
        "privacy",
        lambda s: F.concat(F.lit("  - "), s["title"], F.lit(" ("), s["citation"], F.lit("): "), s["action"]),
    )
    asked = F.transform("open_questions", lambda q: F.concat(F.lit("  - "), _lookup(OPEN_QUESTIONS, q)))
    return F.array_join(
        F.concat(
            F.array(head),
            more,
            F.array(role),
            why,
            _block("Pflichten nach der KI-Verordnung:", duties, blank=False),
            _block("Pflichten nach dem Datenschutzrecht:", privacy, blank=False),
            _block("Offene Fragen:", asked, blank=False),
        ),
        "\n",
    )


def evidence_arrays(evidence: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, evidence): hits of a query in order. The final cut bounds the array."""
    return evidence.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct("place", "unit_key", "citation", "title", "excerpt", "score", "ways"))
        ).alias("evidence")
    )


def evidence_report(evidence: Column, limit: int = 5) -> Column:
    """Report without a classification: the first hits, or that nothing was found."""
    lines = F.flatten(
        F.transform(
            F.slice(evidence, 1, limit),
            lambda e: F.array(
                F.lit(""),
                F.concat(e["citation"], F.lit(" — "), e["title"]),
                F.substring(e["excerpt"], 1, K.REPORT_EXCERPT),
            ),
        )
    )
    return F.when(
        F.coalesce(F.size(evidence), F.lit(0)) > 0,
        F.array_join(F.concat(F.array(F.lit(FOUND)), lines), "\n"),
    ).otherwise(NOTHING)


def prompt(question: Column, description: Column, evidence: Column, facts: Column, fence: Column) -> Column:
    """Request for a language model: user text and evidence stand between unguessable fences, the
    settled facts come after them."""
    quoted = F.when(
        F.length(F.trim(description)) > 0,
        F.concat(
            F.lit("BESCHREIBUNG-"), fence, F.lit("-ANFANG\n"),
            shorten(description, K.PROMPT_DESCRIPTION),
            F.lit("\nBESCHREIBUNG-"), fence, F.lit("-ENDE"),
        ),
    )
    proof = F.array_join(
        F.transform(
            F.slice(evidence, 1, K.PROMPT_EVIDENCE_COUNT),
            lambda e: F.concat(
                F.lit("["), e["citation"], F.lit("] "), e["title"], F.lit("\n"),
                shorten(e["excerpt"], K.PROMPT_EVIDENCE),
            ),
        ),
        "\n\n",
    )
    cited = F.when(
        F.coalesce(F.size(evidence), F.lit(0)) > 0,
        F.concat(F.lit("BELEGE-"), fence, F.lit("-ANFANG\n"), proof, F.lit("\nBELEGE-"), fence, F.lit("-ENDE")),
    )
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("FRAGE DES NUTZERS\n"), shorten(question, K.PROMPT_QUESTION)),
        quoted,
        cited,
        F.concat(F.lit("FESTSTEHENDE EINSTUFUNG\n"), facts),
    )


def random_fence() -> Column:
    return F.substring(F.md5(F.uuid().cast("binary")), 1, 12)


def fence_is_safe(fence: Column, *texts: Column) -> Column:
    """No user text may contain the fence."""
    safe = F.lit(True)
    for t in texts:
        safe = safe & ~F.contains(F.coalesce(t, F.lit("")), fence)
    return safe


def answer_marks(answers: DataFrame) -> DataFrame:
    """(answer_id, mark, shown) of every citation in an answer."""
    return answers.select(
        "answer_id", F.explode(answer_citations(F.col("text"))).alias("c")
    ).select("answer_id", "c.mark", "c.shown")


def unsupported_citations(answers: DataFrame, evidence: DataFrame, match: str = "exact") -> DataFrame:
    """Citations of an answer that none of its evidence rows carries.

    `exact` compares whole marks (anti-join on answer and mark). `substring` also accepts a mark that
    is part of an evidence mark, as in art-5 and art-50.
    """
    cited = answer_marks(answers)
    allowed = evidence.select(
        "answer_id",
        F.explode(evidence_marks(F.col("unit_key"), F.col("citation"), F.col("excerpt"))).alias("allowed"),
    )
    if match == "exact":
        second = F.element_at(F.split("allowed", "/"), 2)
        marks = allowed.select(
            "answer_id",
            F.when(F.contains("allowed", F.lit("/")), second).otherwise(F.col("allowed")).alias("mark"),
        )
        return cited.join(marks, ["answer_id", "mark"], "left_anti")
    if match != "substring":
        raise ValueError(match)
    backed = (
        cited.join(allowed.distinct(), "answer_id")
        .where(F.contains("allowed", F.col("mark")))
        .select("answer_id", "mark")
    )
    return cited.join(backed, ["answer_id", "mark"], "left_anti")


def duty_evidence(classified: DataFrame, duties: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Duties of a classification with the units they cite: legal basis first, then also cited.

    The duty catalogue is small; its citations are resolved against the units once, and only the
    result is joined to the classified rows.
    """
    resolved = duties.select(
        "duty_id", F.posexplode(F.array_union("basis", "also_cited")).alias("pos", "unit_key")
    ).join(units.select("unit_key", "citation"), "unit_key", "left")
    named = classified.select(key, F.explode("duties").alias("d")).select(key, F.col("d.id").alias("duty_id"))
    return lookup_join(named, resolved, ["duty_id"])
