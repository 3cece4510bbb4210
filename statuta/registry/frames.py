"""Stand-in tables derived from the given ones, as expressions both engines understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.tables import load

# documents → corpus units: act by doc_id, article/paragraph numbering by the quotient
UNIT_COLUMNS = {
    "unit_key": """CASE
        WHEN doc_id % 8 = 3 THEN concat('fall/', CAST(doc_id AS STRING))
        WHEN doc_id % 4 = 3 THEN concat('Leitlinie/ll-', CAST(doc_id AS STRING))
        ELSE concat(
            CASE doc_id % 4 WHEN 0 THEN 'KI-VO/' WHEN 1 THEN 'DSGVO/' ELSE 'BDSG/' END,
            CASE WHEN doc_id % 4 = 2 THEN 'par-'
                 WHEN doc_id % 4 = 0 AND floor(doc_id / 12) % 10 = 9 THEN 'anh-'
                 WHEN doc_id % 4 = 1 AND floor(doc_id / 12) % 7 = 6 THEN 'erw-'
                 ELSE 'art-' END,
            CAST(CAST(floor(doc_id / 12) + 1 AS BIGINT) AS STRING),
            CASE WHEN floor(doc_id / 4) % 3 = 0 THEN ''
                 ELSE concat('/abs-', CAST(CAST(floor(doc_id / 4) % 3 AS BIGINT) AS STRING)) END)
        END""",
    "act": """CASE doc_id % 4 WHEN 0 THEN 'KI-VO' WHEN 1 THEN 'DSGVO' WHEN 2 THEN 'BDSG'
        ELSE 'Leitlinie' END""",
    "kind": """CASE WHEN doc_id % 8 = 3 THEN 'fallbeispiel' WHEN doc_id % 4 = 3 THEN 'leitlinie'
        WHEN doc_id % 4 = 2 THEN 'paragraf'
        WHEN doc_id % 4 = 0 AND floor(doc_id / 12) % 10 = 9 THEN 'anhang'
        WHEN doc_id % 4 = 1 AND floor(doc_id / 12) % 7 = 6 THEN 'erwaegungsgrund'
        ELSE 'artikel' END""",
    "number": "CAST(CAST(floor(doc_id / 12) + 1 AS BIGINT) AS STRING)",
    "paragraph": """CASE WHEN doc_id % 4 = 3 OR floor(doc_id / 4) % 3 = 0 THEN NULL
        WHEN doc_id % 5 = 0 THEN concat('Nummer ', CAST(CAST(floor(doc_id / 4) % 3 AS BIGINT) AS STRING))
        ELSE CAST(CAST(floor(doc_id / 4) % 3 AS BIGINT) AS STRING) END""",
    "title": "CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat(lang, '-', CAST(doc_id % 97 AS STRING)) END",
    "chapter": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END",
    "text": "text",
    "source": "source",
    "doc_id": "doc_id",
}
UNITS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in UNIT_COLUMNS.items()) + " FROM documents"

LABEL_SQL = """CASE WHEN kind = 'fallbeispiel' THEN 'Anwendungsfall: ' || coalesce(nullif(title, ''), number)
    WHEN kind = 'leitlinie' THEN coalesce(nullif(title, ''), number)
    ELSE CASE kind WHEN 'artikel' THEN 'Artikel ' WHEN 'paragraf' THEN '§ ' WHEN 'anhang' THEN 'Anhang '
      ELSE 'Erwägungsgrund ' END || number || CASE WHEN paragraph IS NULL THEN ''
      WHEN paragraph LIKE 'Nummer %' THEN ' ' || paragraph
      WHEN kind = 'anhang' THEN ' Nummer ' || paragraph ELSE ' Absatz ' || paragraph END
      || CASE WHEN kind = 'erwaegungsgrund' AND coalesce(paragraph NOT LIKE 'Nummer %', TRUE) THEN ' der ' ELSE ' ' END || act END"""
SEARCH_SQL = f"""concat_ws(chr(10), nullif(concat_ws(' — ', {LABEL_SQL}, nullif(title, ''), nullif(chapter, '')), ''), text)"""

# benchmark → questions that also name places in the law
QUESTION_EXPR = """concat('Art. ', CAST(item_id % 40 + 1 AS STRING), ' Abs. ', CAST(item_id % 4 AS STRING),
    CASE item_id % 3 WHEN 0 THEN ' KI-VO' WHEN 1 THEN ' DSGVO' ELSE '' END,
    ' und § ', CAST(item_id % 30 + 1 AS STRING),
    CASE item_id % 4 WHEN 0 THEN ', Anhang III Nr. 4' WHEN 1 THEN ', Erwägungsgrund 7'
        WHEN 2 THEN ', Artikel 9 Absatz 2 Buchstabe b' ELSE '' END,
    ': ', text)"""
QUESTIONS_SQL = f"SELECT item_id AS query_id, {QUESTION_EXPR} AS text FROM benchmark"

BASE_CTE = f"WITH units AS ({UNITS_SQL}), questions AS ({QUESTIONS_SQL})"


def units(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").selectExpr(
        *[f"{e} AS {n}" for n, e in UNIT_COLUMNS.items()]
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").selectExpr("item_id AS query_id", f"{QUESTION_EXPR} AS text")


# --- SQL fragments -----------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold_sql(c: str) -> str:
    return (
        f"replace(replace(replace(replace(lower({c}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
    )


def fold_ascii_sql(c: str) -> str:
    return f"regexp_replace(strip_accents({fold_sql(c)}), '[^\\x00-\\x7f]', '', 'g')"


STOP_LIST = "[" + ", ".join(quote(w) for w in K.STOP_WORDS) + "]"


def words_sql(folded: str) -> str:
    """Word list of an already folded column."""
    return (
        f"list_concat(list_filter(regexp_extract_all({folded}, '[a-z0-9]+'), lambda w: length(w) >= 2 "
        f"AND NOT list_contains({STOP_LIST}, w)), "
        f"list_filter(flatten(list_transform(regexp_extract_all({folded}, '[a-z]+(?:-[a-z]+)+'), "
        f"lambda w: string_split(w, '-'))), lambda w: length(w) > 2 AND NOT list_contains({STOP_LIST}, w)))"
    )


def bucket_sql(w: str) -> str:
    return f"(CAST(concat('0x', substr(md5({w}), 1, 8)) AS BIGINT) % 256)"


def fraction_sql(*parts: str) -> str:
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(concat('0x', substr(md5({joined}), 1, 8)) AS BIGINT) / 4294967296.0)"


def strip_sql(c: str) -> str:
    blank = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    return f"regexp_replace({c}, '^{blank}+|{blank}+$', '', 'g')"


def normalise_sql(c: str) -> str:
    c = f"translate({c}, chr(160) || chr(8201) || chr(8209), '  -')"
    c = f"regexp_replace({c}, '[ \\t]+', ' ', 'g')"
    c = f"regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip_sql(c)


def values_sql(name: str, columns: tuple[str, ...], rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, (list, tuple)):
            return "CAST([" + ", ".join(lit(x) for x in v) + "] AS VARCHAR[])"
        return quote(str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def as_text(column: str, digits: int | None = None):
    """Array column as one string, for comparison across engines."""
    return F.array_join(F.col(column), "|").alias(column)
