"""Cleaning, guarding, extraction and text-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions import attributes, citations, phrases, text
from statuta.registry.base import query
from statuta.registry.frames import (
    BASE_CTE,
    LABEL_SQL,
    SEARCH_SQL,
    UNITS_SQL,
    fold_ascii_sql,
    fold_sql,
    normalise_sql,
    quote,
    strip_sql,
    units,
)
from statuta.sources import cases
from statuta.tables import load

# dirt that the given texts lack, attached to every row so that every rule has something to do
SPACE_DIRT = " a b‑c  \t d\n\n\n\n"
CONTROL_DIRT = "‮A​B\u0007C\n\n\n\në⁦ ­ende ﻿"
LOG_DIRT = (
    "\nBearer abcDEF.123456 sk-abcdefghijklmnop http://user:geheim99@host/x passwort: hunter2hunter2 "
    + "Zq9" * 20
    + "\r​"
)
BOILER_DIRT = "(12)\n← Art. 5 DSGVO →\nDSGVO\n"


def docs(spark, sf):
    return load(spark, sf, "documents")


@query(
    "p01_normalise_space",
    f"SELECT doc_id, {normalise_sql('text || ' + quote(SPACE_DIRT) + ' || text')} AS text FROM documents",
)
def p01(spark, sf):
    return docs(spark, sf).select(
        "doc_id", text.normalise_space(F.concat("text", F.lit(SPACE_DIRT), "text")).alias("text")
    )


SANITISE_SQL = strip_sql(
    "regexp_replace(regexp_replace(nfc_normalize(text || " + quote(CONTROL_DIRT)
    + r"), '\p{Cf}|[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)


@query("p02_sanitise", f"SELECT doc_id, {SANITISE_SQL} AS text FROM documents")
def p02(spark, sf):
    return docs(spark, sf).select(
        "doc_id", text.sanitise(F.concat("text", F.lit(CONTROL_DIRT))).alias("text")
    )


@query(
    "p03_length_guard",
    f"""SELECT doc_id, CASE WHEN length({strip_sql('text')}) = 0 THEN 'leer'
      WHEN length({strip_sql('text')}) > 2000 THEN 'zu_lang' ELSE 'ok' END AS question,
      CASE WHEN length({strip_sql('text')}) > 20000 THEN 'zu_lang' ELSE 'ok' END AS description
    FROM documents""",
)
def p03(spark, sf):
    clean = docs(spark, sf).select("doc_id", text.sanitise(F.col("text")).alias("t"))
    return clean.select(
        "doc_id",
        text.length_status(F.col("t"), K.MAX_QUESTION).alias("question"),
        text.length_status(F.col("t"), K.MAX_DESCRIPTION, allow_empty=True).alias("description"),
    )


MARKERS = ("token = ", "Copyright", "the of", "de la", "Inhaltsverzeichnis")
CUT_SQL = (
    "substr(t, 1, coalesce(nullif(least("
    + ", ".join(f"coalesce(nullif(strpos(t, {quote(m)}), 0), 1000000000)" for m in MARKERS)
    + "), 1000000000), 1000000001) - 1)"
)
LINES_SQL = (
    f"regexp_replace(regexp_replace(regexp_replace({CUT_SQL}, "
    r"'(?m)^\s*(?:←|→|«|»)?\s*Art\.?\s*\d{1,3}\s*(?:DSGVO|GDPR)?\s*(?:←|→|«|»)?\s*$', '', 'g'), "
    r"'(?m)^\s*\(\s*\d{1,3}\s*\)\s*$', '', 'g'), '(?m)^\s*(?:DSGVO|BDSG|GDPR)\s*$', '', 'g')"
)


@query(
    "p04_boilerplate_cut",
    f"SELECT doc_id, {normalise_sql(LINES_SQL)} AS text FROM (SELECT doc_id, {quote(BOILER_DIRT)} || text AS t FROM documents)",
)
def p04(spark, sf):
    return docs(spark, sf).select(
        "doc_id", text.cut_boilerplate(F.concat(F.lit(BOILER_DIRT), "text"), MARKERS).alias("text")
    )


@query(
    "p05_fold_text",
    f"SELECT doc_id, {fold_sql('text')} AS folded, {fold_ascii_sql('text')} AS plain FROM documents",
)
def p05(spark, sf):
    return docs(spark, sf).select(
        "doc_id", text.fold(F.col("text")).alias("folded"), text.fold_ascii(F.col("text")).alias("plain")
    )


def unit_label():
    return citations.label(*[F.col(c) for c in ("kind", "act", "number", "paragraph", "title")])


@query("p06_citation_label", f"WITH units AS ({UNITS_SQL}) SELECT unit_key, {LABEL_SQL} AS citation FROM units")
def p06(spark, sf):
    return units(spark, sf).select("unit_key", unit_label().alias("citation"))


@query(
    "p07_search_text",
    f"WITH units AS ({UNITS_SQL}) SELECT unit_key, {SEARCH_SQL} AS search_text FROM units",
)
def p07(spark, sf):
    return units(spark, sf).select(
        "unit_key",
        text.search_text(unit_label(), F.col("title"), F.col("chapter"), F.col("text")).alias("search_text"),
    )


# documents → worked cases: sections cut from the text, some of them empty
CASE_FIELDS = {
    "titel": "concat(lang, ' ', source)",
    "lage": "text",
    "rolle": "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'anbieter' ELSE 'betreiber' END",
    "einstufung": "CASE WHEN doc_id % 4 = 0 THEN 'minimal' ELSE 'transparenz' END",
    "begruendung": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE substr(text, 50) END",
    "lernhinweis": "CASE WHEN doc_id % 2 = 0 THEN substr(text, 10) ELSE '' END",
    "stolperstein": "CASE WHEN doc_id % 7 = 0 THEN substr(text, 5) ELSE NULL END",
}
CASES_SQL = (
    "SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in CASE_FIELDS.items())
    + ", CASE WHEN doc_id % 6 = 0 THEN [] ELSE [lang, '', source] END AS pflichten FROM documents"
)
CASE_TEXT_SQL = normalise_sql(
    "array_to_string(list_filter(["
    + ", ".join(
        f"CASE WHEN length({c}) > 0 THEN {quote(label)} || {c} END"
        for name, label in K.CASE_LABELS
        for c in [
            name if name != "pflichten" else "array_to_string(list_filter(pflichten, lambda x: length(x) > 0), '; ')"
        ]
    )
    + "], lambda x: x IS NOT NULL), chr(10) || chr(10))"
)


def case_rows(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", "lang", "source", *[f"{e} AS {n}" for n, e in CASE_FIELDS.items()])
    return d.withColumn(
        "pflichten",
        F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(
            F.array("lang", F.lit(""), "source")
        ),
    )


def case_text():
    return cases.case_document(
        *[
            F.col(c)
            for c in ("titel", "lage", "rolle", "einstufung", "begruendung", "pflichten", "lernhinweis", "stolperstein")
        ]
    )


@query("p08_case_document", f"SELECT doc_id, {CASE_TEXT_SQL} AS text FROM ({CASES_SQL})")
def p08(spark, sf):
    return case_rows(spark, sf).select("doc_id", case_text().alias("text"))


@query(
    "p09_excerpt",
    f"""SELECT doc_id, substr(text, 1, 700) AS excerpt, CASE WHEN length({strip_sql('text')}) > 1400
    THEN substr({strip_sql('text')}, 1, 1400) || chr(10) || '[hier abgeschnitten]' ELSE {strip_sql('text')} END AS shortened
    FROM documents""",
)
def p09(spark, sf):
    return docs(spark, sf).select(
        "doc_id",
        text.excerpt(F.col("text")).alias("excerpt"),
        text.shorten(F.col("text"), K.PROMPT_EVIDENCE).alias("shortened"),
    )


WORDS = ("Ja", " true ", "1", "YES", "wahr", "on", "nein", "FALSE", "0", "no", "falsch", "off", "unbekannt", "")
WORD_EXPR = "CASE event_id % 14 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"


@query(
    "p10_truth_words",
    f"""SELECT event_id, CASE WHEN lower(trim(w)) IN ('true', 'ja', '1', 'yes', 'wahr', 'on') THEN TRUE
    WHEN lower(trim(w)) IN ('false', 'nein', '0', 'no', 'falsch', 'off') THEN FALSE END AS value
    FROM (SELECT event_id, {WORD_EXPR} AS w FROM events)""",
)
def p10(spark, sf):
    e = load(spark, sf, "events").selectExpr("event_id", f"{WORD_EXPR} AS w")
    return e.select("event_id", text.parse_truth(F.col("w")).alias("value"))


# events → explicit attributes of a description, some names unknown, some numbers broken
NAMES = (
    "biometrie", "emotionserkennung", "zweck", "anzahl_beschaeftigte", "rechenaufwand_flop", "farbe",
    "menschliche_kontrolle", "markt", "alter", "grundmodell", "drittlandtransfer",
)
NAME_EXPR = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
VALUE_EXPR = (
    "CASE event_id % 11 WHEN 2 THEN event_type WHEN 7 THEN 'EU' WHEN 3 THEN CASE WHEN event_id % 3 = 0 THEN 'viele' "
    "ELSE CAST(event_id % 90 AS STRING) END WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '1e24' END "
    f"ELSE {WORD_EXPR} END"
)
ATTR_SQL = f"""SELECT user_id, name, value FROM (SELECT user_id, {NAME_EXPR} AS name, {VALUE_EXPR} AS value, ts FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY ts DESC, value DESC) = 1"""


def explicit(spark, sf):
    rows = load(spark, sf, "events").selectExpr("user_id", f"{NAME_EXPR} AS name", f"{VALUE_EXPR} AS value", "ts")
    return attributes.latest_attributes(rows, "user_id")


@query(
    "p11_attribute_override",
    f"""WITH a AS ({ATTR_SQL}), t AS (SELECT *, CASE WHEN lower(trim(value)) IN ('true', 'ja', '1', 'yes', 'wahr', 'on') THEN TRUE
      WHEN lower(trim(value)) IN ('false', 'nein', '0', 'no', 'falsch', 'off') THEN FALSE END AS b,
      TRY_CAST(value AS DOUBLE) AS d FROM a),
    g AS (SELECT user_id, bool_or(CASE WHEN name = 'biometrie' THEN b END) AS biometrie,
      bool_or(CASE WHEN name = 'menschliche_kontrolle' THEN b END) AS menschliche_kontrolle,
      max(CASE WHEN name = 'zweck' THEN value END) AS zweck,
      max(CASE WHEN name = 'anzahl_beschaeftigte' THEN CAST(d AS INT) END) AS anzahl_beschaeftigte,
      max(CASE WHEN name = 'rechenaufwand_flop' THEN d END) AS flop,
      string_agg(DISTINCT CASE WHEN name IN ('farbe', 'alter') OR (name IN ('anzahl_beschaeftigte', 'rechenaufwand_flop') AND d IS NULL) THEN name END, '|'
        ORDER BY CASE WHEN name IN ('farbe', 'alter') OR (name IN ('anzahl_beschaeftigte', 'rechenaufwand_flop') AND d IS NULL) THEN name END) AS unknown
      FROM t GROUP BY user_id)
    SELECT c_custkey AS user_id, coalesce(biometrie, CASE WHEN c_custkey % 2 = 0 THEN TRUE END) AS biometrie, menschliche_kontrolle,
      coalesce(zweck, c_mktsegment) AS zweck, CAST(anzahl_beschaeftigte AS BIGINT) AS anzahl_beschaeftigte,
      coalesce(flop, 1.0) AS flop, coalesce(unknown, '') AS unknown
    FROM customer LEFT JOIN g ON g.user_id = c_custkey""",
)
def p11(spark, sf):
    c = load(spark, sf, "customer")
    described = attributes.describe(
        c.select(F.col("c_custkey").alias("user_id"), F.lit("").alias("t"), "c_mktsegment"), "user_id", "t"
    ).drop("biometrie", "zweck", "rechenaufwand_flop")
    described = described.join(
        c.select(
            F.col("c_custkey").alias("user_id"),
            F.when(F.col("c_custkey") % 2 == 0, True).alias("biometrie"),
            F.col("c_mktsegment").alias("zweck"),
            F.lit(1.0).alias("rechenaufwand_flop"),
        ),
        "user_id",
    )
    out = attributes.override_attributes(described, explicit(spark, sf), "user_id")
    return out.select(
        "user_id",
        "biometrie",
        "menschliche_kontrolle",
        "zweck",
        F.col("anzahl_beschaeftigte").cast("bigint").alias("anzahl_beschaeftigte"),
        F.col("rechenaufwand_flop").alias("flop"),
        F.array_join("unknown", "|").alias("unknown"),
    )


@query(
    "u06_unknown_names",
    f"SELECT DISTINCT name FROM ({ATTR_SQL}) WHERE name IN ('farbe', 'alter')",
)
def u06(spark, sf):
    known = (*attributes.BOOLEANS, *K.TEXT_FIELDS, "rechenaufwand_flop", "anzahl_beschaeftigte", "markt")
    return explicit(spark, sf).where(~F.col("name").isin(*known)).select("name").distinct()


@query(
    "p15_self_count_questions",
    """SELECT conv_id, turn FROM conversations WHERE role = 'user'
    AND NOT starts_with(lower(trim(CASE WHEN (conv_id + turn) % 5 = 0 THEN '  Haben Sie alle ' || text ELSE text END)), 'haben sie alle')""",
)
def p15(spark, sf):
    from statuta.operators.questionnaire import drop_self_counting

    asked = load(spark, sf, "conversations").where("role = 'user'")
    t = F.when(
        (F.col("conv_id") + F.col("turn")) % 5 == 0, F.concat(F.lit("  Haben Sie alle "), "text")
    ).otherwise(F.col("text"))
    return drop_self_counting(asked.withColumn("text", t)).select("conv_id", "turn")


# conversations with a rhetorical question, a seller preamble and a system subject attached
TALK = " Was gilt dann? Wir verkaufen eine Software, die Bewerbungen sortiert und bewertet. Das Tool liest alle Eingaben mit. Sind wir fertig?"
TALK_EXPR = (
    f"CASE WHEN conv_id % 4 = 3 THEN 'Was ist das? Sind wir betroffen?' WHEN turn % 2 = 0 THEN concat(text, '{TALK}') ELSE text END"
)
RHET = "(?i)" + K.RHETORICAL


def sentences_sql(key: str, source: str, column: str = "text") -> str:
    """CTEs raw_s → kept_s → all_s (key, s list) for the sentence rules."""
    seller = K.SELLER_PREAMBLE.replace("'", "''")
    system = K.SYSTEM_SUBJECT.replace("'", "''")
    return f"""raw_s AS (SELECT {key}, list_filter(string_split(regexp_replace({strip_sql(f"regexp_replace({column}, '\\s+', ' ', 'g')")},
      '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS r FROM {source}),
    kept_s AS (SELECT {key}, CASE WHEN len(k) = 0 THEN r ELSE k END AS k FROM (SELECT {key}, r,
      list_filter(r, lambda x: NOT (x LIKE '%?' AND regexp_matches(x, '{RHET}'))) AS k FROM raw_s)),
    all_s AS (SELECT {key}, list_concat(k, list_filter(list_transform(k, lambda x:
      CASE WHEN regexp_matches(x, '(?is){seller}') THEN 'Wir ' || {strip_sql(f"regexp_extract(x, '(?is){seller}', 1)")}
           WHEN regexp_matches(x, '(?is){system}') THEN 'Wir ' || {strip_sql(f"regexp_extract(x, '(?is){system}', 1)")} END),
      lambda x: x IS NOT NULL)) AS s FROM kept_s)"""


@query(
    "x14_sentences",
    f"""WITH src AS (SELECT conv_id * 100 + turn AS id, {TALK_EXPR} AS text FROM conversations), {sentences_sql('id', 'src')}
    SELECT DISTINCT id, unnest(s) AS sentence FROM all_s""",
)
def x14(spark, sf):
    src = load(spark, sf, "conversations").selectExpr("conv_id * 100 + turn AS id", f"{TALK_EXPR} AS text")
    return src.select("id", F.explode(F.array_distinct(text.sentences(F.col("text")))).alias("sentence")).distinct()


@query(
    "p16_rhetorical_questions",
    f"""WITH src AS (SELECT conv_id * 100 + turn AS id, {TALK_EXPR} AS text FROM conversations), {sentences_sql('id', 'src')}
    SELECT id, CAST(len(r) AS BIGINT) AS n_raw, CAST(len(k) AS BIGINT) AS n_kept FROM raw_s JOIN kept_s USING (id)""",
)
def p16(spark, sf):
    src = load(spark, sf, "conversations").selectExpr("conv_id * 100 + turn AS id", f"{TALK_EXPR} AS text")
    raw = src.select("id", text.raw_sentences(F.col("text")).alias("r"))
    return raw.select(
        "id",
        F.size("r").cast("bigint").alias("n_raw"),
        F.size(text.drop_rhetorical(F.col("r"))).cast("bigint").alias("n_kept"),
    )


@query(
    "p14_secret_redaction",
    None,
)
def p14(spark, sf):
    dirty = F.concat("text", F.lit(LOG_DIRT))
    return docs(spark, sf).select(
        "doc_id",
        text.redact(dirty).alias("line"),
        text.secret_count(dirty).cast("bigint").alias("secrets"),
    )


@query(
    "p14_named_secrets",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\btoken\s*[:=]\s*["'']?[^\s"'',;)⟨⟩]{6,}')) AS BIGINT) AS secrets,
    substr(regexp_replace(replace(text, chr(10), ' ⏎ '), '(?i)\b(token\s*)=\s*["'']?[^\s"'',;)⟨⟩]{6,}', '\1= ⟨Schlüssel entfernt⟩', 'g'), 1, 2000)
      || CASE WHEN length(regexp_replace(replace(text, chr(10), ' ⏎ '), '(?i)\b(token\s*)=\s*["'']?[^\s"'',;)⟨⟩]{6,}', '\1= ⟨Schlüssel entfernt⟩', 'g')) > 2000
      THEN ' …⟨gekappt⟩' ELSE '' END AS line FROM documents""",
)
def p14_named(spark, sf):
    return docs(spark, sf).select(
        "doc_id",
        text.secret_count(F.col("text")).cast("bigint").alias("secrets"),
        text.redact(F.col("text")).alias("line"),
    )


@query(
    "p17_in_force",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) <= DATE '1999-06-30' AS in_force,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders""",
)
def p17(spark, sf):
    from statuta.operators.duties import in_force, order_deadlines

    o = load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("deadline")
    )
    flagged = o.withColumn("in_force", in_force(F.col("deadline"), F.to_date(F.lit("1999-06-30"))))
    return order_deadlines(flagged, "o_custkey", "o_orderkey").select(
        "o_orderkey", "in_force", F.col("pos").cast("bigint").alias("pos")
    )


@query(
    "p22_valid_at",
    """SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN o_orderdate IS NULL OR o_orderdate <= l_shipdate THEN 1 ELSE 0 END) AS BIGINT) AS valid
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def p22(spark, sf):
    from statuta.operators.duties import valid_at

    items = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("as_of"))
    rules = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("valid_from"))
    return (
        items.join(rules, "l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.sum(valid_at(F.col("valid_from"), F.col("as_of")).cast("bigint")).alias("valid"))
    )


@query(
    "p19_confidence_band",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 10 >= 0.90 THEN 'sicher' WHEN l_discount * 10 >= 0.70
    THEN 'wahrscheinlich' ELSE 'zu prüfen' END AS band FROM lineitem""",
)
def p19(spark, sf):
    from statuta.operators.purposes import confidence_band

    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", confidence_band(F.col("l_discount") * 10).alias("band")
    )


ANSWER_WORDS = "CASE event_id % 9 WHEN 0 THEN 'trifft_nicht_zu' WHEN 1 THEN 'trifft nicht zu' WHEN 2 THEN '?' WHEN 3 THEN NULL WHEN 4 THEN 'ja' WHEN 5 THEN 'true' WHEN 6 THEN 'Nein' WHEN 7 THEN '0' ELSE 'vielleicht' END"


@query(
    "p20_answer_normalise",
    f"""SELECT event_id, CASE WHEN w IN ('trifft_nicht_zu', 'trifft nicht zu', '?') THEN 'na' WHEN lower(w) IN ('ja', 'true') THEN 'yes'
    WHEN lower(w) IN ('nein', '0') THEN 'no' END AS answer FROM (SELECT event_id, {ANSWER_WORDS} AS w FROM events)
    WHERE w IS NOT NULL AND w <> 'vielleicht'""",
)
def p20(spark, sf):
    e = load(spark, sf, "events").selectExpr("event_id", f"{ANSWER_WORDS} AS w")
    return e.select("event_id", text.normalise_answer(F.col("w")).alias("answer")).where("answer IS NOT NULL")


@query(
    "p12_filled_fields",
    """SELECT doc_id, CAST((CASE WHEN lang <> '' THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)
    + (CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM documents""",
)
def p12(spark, sf):
    d = docs(spark, sf).select(
        "doc_id",
        F.col("text").alias("free_text"),
        F.col("lang").alias("zweck"),
        F.lit("").alias("einsatzbereich"),
        F.when(F.col("doc_id") % 2 == 0, True).alias("biometrie"),
        F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("anbieter")))
        .otherwise(F.array().cast("array<string>"))
        .alias("roles"),
        F.when(F.col("doc_id") % 5 == 0, 1e20).alias("rechenaufwand_flop"),
        F.lit("EU").alias("markt"),
    )
    fields = [c for c in d.columns if c != "doc_id"]
    return d.select("doc_id", attributes.filled_count(fields).cast("bigint").alias("filled"))


@query(
    "p18_lesson",
    f"""WITH c AS (SELECT doc_id, CAST(replace(source, 'src', '') AS BIGINT) AS query_id, {CASE_TEXT_SQL} AS t, titel, lernhinweis, doc_id AS place FROM
      (SELECT c.*, d.source FROM ({CASES_SQL}) c JOIN documents d USING (doc_id))),
    l AS (SELECT *, trim(substr(list_filter(string_split(t, chr(10) || chr(10)), lambda x: starts_with(x, 'Worauf es ankommt:'))[1], 19)) AS lesson FROM c)
    SELECT query_id, min_by(lesson, place) FILTER (WHERE length(lesson) > 0) AS lesson,
      array_to_string(list_slice(list(titel ORDER BY place), 1, 5), '|') AS cases FROM l GROUP BY query_id""",
)
def p18(spark, sf):
    rows = case_rows(spark, sf)
    u = rows.select(
        F.col("doc_id").alias("unit_key"),
        F.lit(K.KIND_CASE).alias("kind"),
        F.col("titel").alias("title"),
        F.col("doc_id").cast("string").alias("number"),
        case_text().alias("text"),
    )
    hits = rows.select(
        F.replace("source", F.lit("src"), F.lit("")).cast("bigint").alias("query_id"),
        F.col("doc_id").alias("place"),
        F.col("doc_id").alias("unit_key"),
    )
    return cases.lessons_from_hits(hits, u).select("query_id", "lesson", F.array_join("cases", "|").alias("cases"))


@query(
    "x12_count_marker_split",
    f"""WITH t AS (SELECT doc_id, concat('(1) ', text, ' ', text, chr(10), '(2) kurz', chr(10), '  (3) ', text) AS t FROM documents),
    p AS (SELECT doc_id, regexp_extract_all(t, '(?m)^\\s*\\((\\d{{1,2}})\\)\\s+', 1) AS n,
      string_split(regexp_replace(t, '(?m)^\\s*\\(\\d{{1,2}}\\)\\s+', chr(1), 'g'), chr(1))[2:] AS x FROM t)
    SELECT * FROM (SELECT doc_id, unnest(n) AS paragraph, unnest(list_transform(x, lambda v: {normalise_sql('v')})) AS text FROM p)
    WHERE length(text) > 25""",
)
def x12(spark, sf):
    marked = F.concat(
        F.lit("(1) "), "text", F.lit(" "), "text", F.lit("\n(2) kurz\n  (3) "), "text"
    )
    return docs(spark, sf).select(
        "doc_id", F.inline(text.count_marker_split(marked))
    ).select("doc_id", F.col("count").alias("paragraph"), "text")


CITED_TEXT = (
    "concat(text, ' Artikel ', CAST(turn + 1 AS STRING), ' Absatz 2, § 26a; Anhang III Nummer 4, Art. ', "
    "CAST(conv_id % 90 AS STRING), ' und Artikel ', CAST(turn + 1 AS STRING))"
)


@query(
    "x17_answer_citations",
    f"""WITH a AS (SELECT conv_id, turn, regexp_extract_all({CITED_TEXT},
      '(?:Artikel|Art\\.)\\s*\\d{{1,3}}(?:\\s*Absatz\\s*\\d{{1,2}})?|§\\s*\\d{{1,3}}[a-z]?|Anhang\\s+[IVXLC]+(?:\\s*Nummer\\s*\\d{{1,2}})?') AS p
      FROM conversations WHERE role = 'assistant')
    SELECT DISTINCT conv_id, turn, CASE WHEN x LIKE 'Art%' THEN 'art-' || regexp_extract(x, '(\\d+)', 1)
      WHEN x LIKE '§%' THEN 'par-' || regexp_extract(x, '(\\d+[a-z]?)', 1) ELSE 'anh-' || regexp_extract(x, 'Anhang\\s+([IVXLC]+)', 1) END AS mark
    FROM (SELECT conv_id, turn, unnest(p) AS x FROM a)""",
)
def x17(spark, sf):
    a = load(spark, sf, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id", "turn", f"{CITED_TEXT} AS t"
    )
    return a.select("conv_id", "turn", F.explode(citations.answer_citations(F.col("t"))).alias("c")).select(
        "conv_id", "turn", "c.mark"
    )


BUDGETS = (
    "Rechenaufwand 2,5 x 10^25", "Trainingsaufwand: 10²⁵ Operationen", "1e26 FLOP", "10 hoch 24 Gleitkommaoperationen",
    "Jahr 1e26", "flop 10^99", "rechenleistung 3 mal 10**22",
)
BUDGET_EXPR = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{b} '" for i, b in enumerate(BUDGETS)) + " END"
BUDGET_RE = "(?i)(?:(\\d+(?:[.,]\\d+)?)\\s*(?:x|\\*|·|mal)\\s*)?(?:10\\s*(?:\\^|\\*\\*|hoch\\s*)?|1\\s*e)\\s*([0-9⁰¹²³⁴⁵⁶⁷⁸⁹]{1,3})(?:[^0-9]|$)"


@query(
    "x18_compute_budget",
    f"""WITH d AS (SELECT doc_id, {BUDGET_EXPR} || text AS t FROM documents),
    e AS (SELECT doc_id, t, coalesce(CAST(replace(nullif(regexp_extract(t, '{BUDGET_RE}', 1), ''), ',', '.') AS DOUBLE), 1.0) AS f,
      TRY_CAST(translate(regexp_extract(t, '{BUDGET_RE}', 2), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') AS INT) AS x FROM d)
    SELECT doc_id, round(log10(f * pow(10.0, x)), 6) AS magnitude FROM e WHERE x BETWEEN 10 AND 40 AND regexp_matches({fold_sql('t')},
      'rechenoperation|gleitkommaoperation|flop|rechenaufwand|rechenleistung|trainingsaufwand|operationen trainiert')""",
)
def x18(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"concat({BUDGET_EXPR}, text) AS t")
    return d.select("doc_id", citations.compute_budget(F.col("t")).alias("flop")).where("flop IS NOT NULL").select(
        "doc_id", F.round(F.log10("flop"), 6).alias("magnitude")
    )


ROLE_TEXTS = ("Wir entwickeln es. ", "Wir nutzen es. ", "Wir bauen und wir betreiben es. ", "Nichts davon. ", "Eingekauft, im Einsatz. ")
ROLE_EXPR = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(ROLE_TEXTS)) + " END"


@query(
    "x19_role_detection",
    f"""WITH d AS (SELECT doc_id, {fold_sql(ROLE_EXPR + ' || text')} AS t FROM documents)
    SELECT doc_id, concat_ws('|', CASE WHEN regexp_matches(t, {quote('|'.join(K.PROVIDER_PHRASES))}) THEN 'anbieter' END,
      CASE WHEN regexp_matches(t, {quote('|'.join(K.DEPLOYER_PHRASES))}) THEN 'betreiber' END) AS roles FROM d""",
)
def x19(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"concat({ROLE_EXPR}, text) AS t")
    return d.select("doc_id", F.array_join(citations.roles_from_text(F.col("t")), "|").alias("roles"))


@query(
    "c15_description_builder",
    f"""WITH d AS (SELECT doc_id, {strip_sql(f"regexp_replace({ROLE_EXPR} || {BUDGET_EXPR} || text || text, '\\s+', ' ', 'g')")} AS t FROM documents)
    SELECT doc_id, md5(substr(t, 1, 20000)) AS digest, CAST(length(substr(t, 1, 20000)) AS BIGINT) AS chars, concat_ws('|',
      CASE WHEN regexp_matches({fold_sql('t')}, {quote('|'.join(K.PROVIDER_PHRASES))}) THEN 'anbieter' END,
      CASE WHEN regexp_matches({fold_sql('t')}, {quote('|'.join(K.DEPLOYER_PHRASES))}) THEN 'betreiber' END) AS roles FROM d""",
)
def c15(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"concat({ROLE_EXPR}, {BUDGET_EXPR}, text, text) AS t")
    return attributes.describe(d, "doc_id", "t").select(
        "doc_id",
        F.md5(F.col("free_text").cast("binary")).alias("digest"),
        F.length("free_text").cast("bigint").alias("chars"),
        F.array_join("roles", "|").alias("roles"),
    )


# ---- text-rule predicates on the folded text, with words that occur in it ------------------

START = "(^|[^\\p{L}\\p{N}_])"


def stem_sql(t: str, stem: str) -> str:
    return f"contains({t}, {quote(stem)})" if len(stem) >= 5 else f"regexp_matches({t}, '{START}{stem}')"


def strong_sql(t: str, word: str) -> str:
    w = phrases.fold_text(word)
    return f"regexp_matches({t}, {quote(START + w)})" if len(w) > 3 else "FALSE"


def feature_sql(t: str, phrase: str) -> str:
    parts = [p for p in phrase.split() if len(p) > 3]
    return "(" + " AND ".join(stem_sql(t, p) for p in parts) + ")" if parts else f"contains({t}, {quote(phrase)})"


def phrase_sql(t: str, phrase: str) -> str:
    parts = [p for p in phrases.fold_text(phrase).split() if len(p) > 3]
    return "(" + " AND ".join(strong_sql(t, p) for p in parts) + ")" if parts else "FALSE"


def any_sql(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


FOLDED = f"(SELECT doc_id, {fold_sql('text')} AS t FROM documents)"


def folded(spark, sf):
    return docs(spark, sf).select("doc_id", text.fold(F.col("text")).alias("t"))


def rule_query(name, sql_expr, column):
    @query(name, f"SELECT doc_id, {sql_expr('t')} AS hit FROM {FOLDED}")
    def run(spark, sf):
        return folded(spark, sf).select("doc_id", column(F.col("t")).alias("hit"))


rule_query(
    "k01_feature_phrase",
    lambda t: any_sql([feature_sql(t, p) for p in ("tion heit", "of a", "mente ción")]),
    lambda t: phrases.feature_hit(t, ("tion heit", "of a", "mente ción")),
)
rule_query(
    "k02_stem_hit",
    lambda t: any_sql([stem_sql(t, s) for s in ("ungen", "with", "tre")]),
    lambda t: phrases.stem_anywhere(t, "ungen") | phrases.stem_anywhere(t, "with") | phrases.stem_anywhere(t, "tre"),
)
rule_query(
    "k03_strong_word",
    lambda t: any_sql([strong_sql(t, s) for s in ("thatt", "Nicht", "the", "für")]),
    lambda t: phrases.strong_hit(t, ("thatt", "Nicht", "the", "für")),
)
rule_query(
    "k04_rule_phrase",
    lambda t: any_sql([phrase_sql(t, s) for s in ("that with", "nicht eine", "of to", "dans")]),
    lambda t: phrases.phrase_hit(t, ("that with", "nicht eine", "of to", "dans")),
)
rule_query(
    "k05_carrier_action",
    lambda t: any_sql([strong_sql(t, s) for s in ("thes", "nich")]) + " AND " + any_sql([phrase_sql(t, s) for s in ("with that", "sich")]),
    lambda t: phrases.carrier_action(t, ("thes", "nich"), ("with that", "sich")),
)
rule_query(
    "p21_required_wording",
    lambda t: any_sql([f"contains({t}, {quote(w)})" for w in ("from the", "ueber", "sont")]),
    lambda t: phrases.required_wording(t, ("From the", "über", "sont")),
)


@query(
    "j09_keyword_rules",
    f"""SELECT r AS rule, CAST(count(*) AS BIGINT) AS texts FROM (
      SELECT doc_id, unnest(list_filter(['eins', 'zwei', 'drei'], lambda x: CASE x WHEN 'eins' THEN {any_sql([phrase_sql('t', 'that with')])}
        WHEN 'zwei' THEN {any_sql([strong_sql('t', 'nicht'), phrase_sql('t', 'dans sont')])}
        ELSE {any_sql([feature_sql('t', 'tion ment')])} END)) AS r FROM {FOLDED}) GROUP BY r""",
)
def j09(spark, sf):
    t = F.col("t")
    hits = F.array_compact(
        F.array(
            F.when(phrases.phrase_hit(t, ("that with",)), "eins"),
            F.when(phrases.strong_hit(t, ("nicht",)) | phrases.phrase_hit(t, ("dans sont",)), "zwei"),
            F.when(phrases.feature_hit(t, ("tion ment",)), "drei"),
        )
    )
    return (
        folded(spark, sf)
        .select(F.explode(hits).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("texts"))
    )


@query(
    "k06_all_true",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END, FALSE)
    AND coalesce(CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice > 100000 END, FALSE) AS met FROM orders""",
)
def k06(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus") == "F")
    price = F.when(F.col("o_totalprice") > 400000, F.lit(None)).otherwise(F.col("o_totalprice") > 100000)
    return load(spark, sf, "orders").select("o_orderkey", phrases.all_true([status, price]).alias("met"))


@query(
    "k07_explicit_over_derived",
    f"""SELECT doc_id, coalesce(CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END,
      CASE WHEN contains(t, 'tion ') THEN TRUE END) AS value FROM {FOLDED}""",
)
def k07(spark, sf):
    from statuta.operators.features import explicit_or_derived

    given = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)
    derived = phrases.literal_hit(F.col("t"), ("tion ",))
    return folded(spark, sf).select("doc_id", explicit_or_derived(given, derived).alias("value"))
