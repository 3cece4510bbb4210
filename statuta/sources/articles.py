"""Article JSON files of a secondary source: recursive scan and nested split into units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.text import count_marker_split, cut_boilerplate, normalise_space
from statuta.tables import ARTICLE_JSON_DDL

CONTENTS_FILE = "inhaltsverzeichnis.json"
KIND_OF = {"artikel": K.KIND_ARTICLE, "anhang": K.KIND_ANNEX, "erwaegungsgrund": K.KIND_RECITAL}
STEM_OF = {"artikel": "art", "anhang": "anh", "erwaegungsgrund": "erw"}
MIN_PART = 25


def read_articles(spark: SparkSession, path: str, files: str = "*.json") -> DataFrame:
    """All article files below a folder; `_…` files, the contents file and unreadable rows are skipped.

    A file holds one article or a list of them; many small articles are better kept in lists, as every
    file costs an opening. `files` is the pattern of the names that are read.
    """
    name = F.element_at(F.split("_path", "/"), -1)
    reader = (
        spark.read.schema(ARTICLE_JSON_DDL)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", files)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
    )
    rows = reader.json(path).select(
        "*", F.col("_metadata.file_path").alias("_path"),
        F.to_date("_metadata.file_modification_time").alias("as_of"),
    )
    return rows.where(
        F.col("_corrupt").isNull() & ~F.startswith(name, F.lit("_")) & (name != CONTENTS_FILE)
    ).drop("_corrupt", "_path")


def _map(column: str, values: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return table[F.coalesce(F.col(column), F.lit("artikel"))]


def article_rows(articles: DataFrame, act: str | Column) -> DataFrame:
    """article → (article, paragraphs, letters) units; without nested paragraphs the count markers
    of the running text decide; annexes and recitals stop at their stem."""
    act = F.lit(act) if isinstance(act, str) else act
    base = articles.select(
        "*",
        act.alias("act"),
        _map("einheit", KIND_OF).alias("kind"),
        F.concat(act, F.lit("/"), _map("einheit", STEM_OF), F.lit("-"), "nummer").alias("stem"),
        cut_boilerplate(F.coalesce("text", F.lit(""))).alias("body"),
        normalise_space(F.coalesce("titel", F.lit(""))).alias("title"),
    ).where("nummer IS NOT NULL AND body <> ''")

    def unit(df: DataFrame, suffix: Column, paragraph: Column, text: Column) -> DataFrame:
        return df.select(
            F.concat("stem", suffix).alias("unit_key"), "act", "kind", F.col("nummer").alias("number"),
            paragraph.cast("string").alias("paragraph"), "title", text.alias("text"),
            F.coalesce("quelle", F.lit("")).alias("source"),
        )

    nested = F.coalesce(F.size("absaetze"), F.lit(0)) > 0
    only_articles = base.where(F.col("kind") == K.KIND_ARTICLE)
    paras = only_articles.where(nested).select("*", F.explode("absaetze").alias("p")).select(
        "*", F.trim("p.nummer").alias("count"), normalise_space(F.coalesce("p.text", F.lit(""))).alias("ptext")
    ).where((F.coalesce("count", F.lit("")) != "") & (F.length("ptext") >= MIN_PART))
    points = paras.select("*", F.explode("p.buchstaben").alias("b")).select(
        "*", F.trim("b.buchstabe").alias("letter"), normalise_space(F.coalesce("b.text", F.lit(""))).alias("btext")
    ).where((F.coalesce("letter", F.lit("")) != "") & (F.length("btext") >= MIN_PART))
    marked = only_articles.where(~nested).select("*", F.explode(count_marker_split(F.col("body"))).alias("m"))
    none = F.lit(None)
    return (
        unit(base, F.lit(""), none, F.col("body"))
        .unionByName(unit(paras, F.concat(F.lit("/abs-"), "count"), F.col("count"), F.col("ptext")))
        .unionByName(
            unit(
                points,
                F.concat(F.lit("/abs-"), "count", F.lit("-"), "letter"),
                F.concat("count", F.lit(" Buchstabe "), "letter"),
                F.col("btext"),
            )
        )
        .unionByName(
            unit(marked, F.concat(F.lit("/abs-"), F.col("m.count")), F.col("m.count"), F.col("m.text"))
        )
    )
