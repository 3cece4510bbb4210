"""Citable units from the node table, as set-based rules over nodes in document order.

All rules work inside a page. The node table is hash-partitioned by page once; every window, join
and grouping below has the page as leading key and reuses that partitioning. A page is one input
row, so no group is larger than a page.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.text import count_marker_split, let, normalise_space
from statuta.operators.corpus import first_wins
from statuta.operators.scale import checked_broadcast, lookup_join
from statuta.session import cut_lineage
from statuta.sources.pages import node_table

UNIT_COLUMNS = (
    "page_id", "act", "unit_key", "kind", "number", "paragraph", "title", "chapter", "section",
    "text", "ord",
)


def has_class(names: str) -> Column:
    return F.coalesce(F.col("class").rlike(rf"(^|\s)(?:{names})(\s|$)"), F.lit(False))


def _is_id(pattern: str) -> Column:
    return F.coalesce(F.col("node_id").rlike(pattern), F.lit(False))


def partition_by_page(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("page_id")


def enclosing(nodes: DataFrame, tag: str | None, pattern: str, name: str, start: int = 1) -> DataFrame:
    """Adds `name`: (seq, value) of the innermost node of the tag and an id of that form that holds the row.

    The value is the id from character `start` on. Nodes know the ids above them, so nothing is shuffled; where
    ids were given afterwards, the last such node in page order that still encloses the row counts.
    """
    test = _is_id(pattern) if tag is None else (F.col("tag") == tag) & _is_id(pattern)
    value = F.substr("node_id", F.lit(start))
    if "up" not in nodes.columns:
        return enclosing_before(nodes, test, name, value)
    above = F.try_element_at(
        F.filter("up", lambda u: u["id"].rlike(pattern) & (F.lit(True) if tag is None else u["tag"] == tag)), F.lit(-1)
    )
    own = F.when(test, F.struct("seq", value.alias("value")))
    held = let(above, lambda u: F.when(u.isNotNull(), F.struct(u["seq"].alias("seq"), F.substr(u["id"], F.lit(start)).alias("value"))))
    return nodes.withColumn(name, F.coalesce(own, held))


def enclosing_before(nodes: DataFrame, test: Column, name: str, value: Column) -> DataFrame:
    """Adds `name`: (seq, end_seq, value) of the last matching node that still encloses the row."""
    order = W.partitionBy("page_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(test, F.struct("seq", "end_seq", value.alias("value"))), ignorenulls=True).over(order)
    carried = nodes.withColumn("_c", last)
    return carried.withColumn(
        name, F.when(F.col("seq") <= F.col("_c.end_seq"), F.col("_c"))
    ).drop("_c")


def first_inside(ctx: DataFrame, container: str, names: str, title: str) -> DataFrame:
    """(page_id, <container>_seq, title): text of the first node of such a class in every container."""
    return (
        ctx.where(F.col(container).isNotNull() & has_class(names) & F.col("text").isNotNull())
        .groupBy("page_id", F.col(container + ".seq").alias(container + "_seq"))
        .agg(F.min_by("text", "seq").alias(title))
    )


def with_context(nodes: DataFrame) -> DataFrame:
    """Nodes with the chapter, section and article that hold them; their titles are looked up for articles only."""
    n = nodes if "up" in nodes.columns else partition_by_page(nodes)
    n = enclosing(n, None, r"^cpt_[IVXLC]+$", "cpt")
    n = enclosing(n, None, r"^cpt_[IVXLC]+\.sct_\d+$", "sct")
    return enclosing(n, "div", r"^art_\d+$", "art", 5)


READ_CLASSES = r"oj-ti-section-[12]|oj-ti-grseq\S*|eli-title|oj-sti-art|oj-normal|oj-doc-ti"
READ_IDS = r"art_\d+|\d{3}\.\d{3}|anx_[IVXLC]+|rct_\d+"
_CLASSES, _IDS = re.compile(READ_CLASSES), re.compile(f"(?:{READ_IDS})")


def may_be_read(tag: str, node_id: str | None, classes: str | None) -> bool:
    """For the parser: a node that the unit rules may read. It lets through some more than `is_read`, never less."""
    return tag == "table" or (node_id is not None and _IDS.match(node_id) is not None) or (classes is not None and _CLASSES.search(classes) is not None)


def is_read() -> Column:
    """Nodes whose rows and texts the unit rules read."""
    return (F.col("tag") == "table") | has_class(READ_CLASSES) | _is_id(f"^(?:{READ_IDS})$")


def unit_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with their context, with the texts that the unit rules read and no others, written once.

    A text stands in every node around it; those of chapters, rows and cells are the larger part.
    """
    return cut_lineage(with_context(nodes.withColumn("text", F.when(is_read(), F.col("text"))).drop("path")), "nodes")


def table_labels(nodes: DataFrame) -> DataFrame:
    """(page_id, table_seq, first_cell, label, text_cell, cells) from the first row of every table.

    The label is the first non-empty cell among all but the last; the next cell holds the text.
    """
    return nodes.where("tag = 'table' AND label IS NOT NULL").select("page_id", F.col("seq").alias("table_seq"), *_label_columns())


def _label_columns() -> list[Column]:
    return [
        F.col("label.cells").alias("cells"),
        F.regexp_replace("label.first", r"[.)]+$", "").alias("first_cell"),
        F.coalesce(F.regexp_replace("label.label", r"[.)]+$", ""), F.lit("")).alias("label"),
        F.col("label.text_cell").alias("text_cell"),
    ]


def without_label(text: Column, label: Column) -> Column:
    """Item text without its leading `label.` or `label)`."""
    lead = F.concat(F.lit(r"^\Q"), label, F.lit(r"\E[.)]\s*"))
    return F.regexp_replace(F.regexp_replace(text, lead, ""), r"^\s+|\s+$", "")


def item_tables(ctx: DataFrame) -> DataFrame:
    """Tables with label, first cell and text without the label."""
    return ctx.where("tag = 'table' AND label IS NOT NULL").select(
        *[c for c in ctx.columns if c != "label"], *_label_columns()
    )


def article_bodies(ctx: DataFrame) -> DataFrame:
    """One row per article container with its title, chapter and section."""
    bodies = ctx.where(F.col("seq") == F.col("art.seq")).select(
        "page_id",
        F.col("art.seq").alias("art_seq"),
        F.col("art.value").alias("number"),
        F.col("cpt.seq").alias("cpt_seq"),
        F.col("sct.seq").alias("sct_seq"),
        F.replace("cpt.value", F.lit("cpt_"), F.lit("Kapitel ")).alias("_cpt"),
        F.substring_index("sct.value", ".", -1).alias("_sct"),
        "text",
    )
    for container, names, title in (
        ("cpt", "oj-ti-section-1|oj-ti-section-2", "_cpt_title"),
        ("sct", "oj-ti-grseq-1", "_sct_title"),
        ("art", "eli-title", "_eli_title"),
        ("art", "oj-sti-art", "_sti_title"),
    ):
        bodies = bodies.join(first_inside(ctx, container, names, title), ["page_id", container + "_seq"], "left")
    return bodies.select(
        "page_id",
        "art_seq",
        "number",
        F.coalesce("_eli_title", "_sti_title", F.lit("")).alias("title"),
        F.when(F.col("cpt_seq").isNotNull(), F.coalesce("_cpt_title", "_cpt")).otherwise("").alias("chapter"),
        F.when(F.col("sct_seq").isNotNull(), F.coalesce("_sct_title", "_sct")).otherwise("").alias("section"),
        "text",
    )


def definitions(ctx: DataFrame) -> DataFrame:
    """Numbered table items directly under an article, longer than 30 characters."""
    items = item_tables(ctx).where(
        F.col("parent_seq").eqNullSafe(F.col("art.seq"))
        & (F.col("cells") >= 2)
        & F.col("first_cell").rlike(r"^\d{1,3}$")
    )
    return items.select(
        "page_id",
        F.col("art.seq").alias("art_seq"),
        "seq",
        F.col("first_cell").alias("paragraph"),
        without_label(F.col("text"), F.col("first_cell")).alias("text"),
    ).where(F.length("text") > 30)


def paragraphs(ctx: DataFrame) -> DataFrame:
    """Paragraph containers of an article; articles without any fall back to their normal text.

    Containers whose first number is not the article's own quote another act and are left out.
    """
    own = F.regexp_extract(F.col("node_id"), r"^(\d{3})\.(\d{3})$", 1).try_cast("int")
    count = F.regexp_extract(F.col("node_id"), r"^(\d{3})\.(\d{3})$", 2).try_cast("int").cast("string")
    lead = F.regexp_extract(F.col("text"), r"^\(?(\d{1,2})\)?\.?\s+", 1)
    body = F.when(
        lead == count, F.trim(F.regexp_replace("text", r"^\(?(\d{1,2})\)?\.?\s+", ""))
    ).otherwise(F.col("text"))
    boxes = ctx.where(
        (F.col("tag") == "div")
        & F.col("parent_seq").eqNullSafe(F.col("art.seq"))
        & _is_id(r"^\d{3}\.\d{3}$")
        & (own.cast("string") == F.col("art.value"))
    ).select(
        "page_id",
        F.col("art.seq").alias("art_seq"),
        "seq",
        count.alias("paragraph"),
        body.alias("text"),
        F.col("seq").alias("box_seq"),
    ).where("text <> ''")
    bodies = ctx.where(F.col("seq") == F.col("art.seq")).select("page_id", F.col("art.seq").alias("art_seq"))
    loose = (
        ctx.where((F.col("tag") == "p") & has_class("oj-normal") & F.col("art").isNotNull() & (F.col("text") != ""))
        .select("page_id", F.col("art.seq").alias("art_seq"), "seq", "text")
        .join(boxes.select("page_id", "art_seq").distinct(), ["page_id", "art_seq"], "left_anti")
        .groupBy("page_id", "art_seq")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]),
                "\n\n",
            ).alias("text")
        )
        .select(
            "page_id",
            "art_seq",
            F.col("art_seq").alias("seq"),
            F.lit("1").alias("paragraph"),
            "text",
            F.col("art_seq").alias("box_seq"),
        )
    )
    return boxes.unionByName(loose).join(bodies, ["page_id", "art_seq"])


def letters(ctx: DataFrame, paras: DataFrame) -> DataFrame:
    """Lettered table items directly in a paragraph, longer than 40 characters.

    When a letter of the first run comes again, a new sub-paragraph starts and its items are marked
    `ua2-a`. Two windows: the position of the first repetition, then a running count of letters of
    the first run from there on.
    """
    items = (
        item_tables(ctx)
        .where(F.col("label").rlike("^[a-z]$"))
        .select(
            "page_id",
            F.col("parent_seq").alias("box_seq"),
            "seq",
            "label",
            without_label(F.col("text"), F.col("label")).alias("text"),
        )
        .where(F.length("text") > 40)
        .join(
            paras.select("page_id", "art_seq", "box_seq", "paragraph"), ["page_id", "box_seq"]
        )
    )
    return items.withColumn("mark", restart_mark(["page_id", "box_seq"], "label"))


def restart_mark(group: list[str], label: str) -> Column:
    """Label, or `ua<n>-label` from the n-th restart of the lettering on."""
    whole = W.partitionBy(*group).orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    running = W.partitionBy(*group).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    listed = F.collect_list(F.struct(F.col("seq"), F.col(label).alias("label"))).over(whole)
    repeat = F.array_min(
        F.transform(
            F.filter(
                listed,
                lambda x: F.exists(
                    listed, lambda y: (y["label"] == x["label"]) & (y["seq"] < x["seq"])
                ),
            ),
            lambda x: x["seq"],
        )
    )
    first_run = F.transform(F.filter(listed, lambda x: x["seq"] < repeat), lambda x: x["label"])
    seen = F.collect_list(F.struct(F.col("seq"), F.col(label).alias("label"))).over(running)
    restarts = F.size(
        F.filter(
            seen, lambda x: (x["seq"] >= repeat) & F.array_contains(first_run, x["label"])
        )
    )
    part = F.when(repeat.isNull(), F.lit(1)).otherwise(restarts + 1)
    return F.when(part == 1, F.col(label)).otherwise(
        F.concat(F.lit("ua"), part.cast("string"), F.lit("-"), F.col(label))
    )


def _ord(kind: int, container: Column, seq: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), container.alias("container"), seq.alias("seq"))


def article_units(ctx: DataFrame, act: Column) -> DataFrame:
    """Articles, definitions, paragraphs and letters as units."""
    defs = definitions(ctx)
    bodies = ctx.where(F.col("seq") == F.col("art.seq")).select("page_id", F.col("art.seq").alias("art_seq"), "text")
    keys = ["page_id", "art_seq"]
    defining = defs.select(*keys).distinct()
    paras = paragraphs(ctx).join(defining, keys, "left_anti")
    head = cut_lineage(article_bodies(ctx).drop("text"), "heads")  # every kind of unit reads it
    full = paras.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seq", "paragraph", "text"))),
                lambda p: F.concat(F.lit("("), p["paragraph"], F.lit(") "), p["text"]),
            ),
            "\n\n",
        ).alias("full")
    )
    stem = F.concat(act, F.lit("/art-"), F.col("number"))

    def unit(df: DataFrame, suffix: Column, paragraph: Column, text: str, seq: Column) -> DataFrame:
        return df.select(
            "page_id",
            act.alias("act"),
            F.concat(stem, suffix).alias("unit_key"),
            F.lit(K.KIND_ARTICLE).alias("kind"),
            "number",
            paragraph.cast("string").alias("paragraph"),
            "title",
            "chapter",
            "section",
            F.col(text).alias("text"),
            _ord(1, F.col("art_seq"), seq).alias("ord"),
        )

    none = F.lit(None)
    lettered = letters(ctx, paras)
    parts = [
        unit(bodies.join(defining, keys, "left_semi").join(head, keys), F.lit(""), none, "text", F.lit(-1)),
        unit(
            defs.join(head, keys),
            F.concat(F.lit("/nr-"), "paragraph"),
            F.concat(F.lit("Nummer "), "paragraph"),
            "text",
            F.col("seq"),
        ),
        unit(full.join(head, keys), F.lit(""), none, "full", F.lit(-1)),
        unit(
            paras.where(F.length("text") >= 25).join(head, keys),
            F.concat(F.lit("/abs-"), "paragraph"),
            F.col("paragraph"),
            "text",
            F.col("seq"),
        ),
        unit(
            lettered.join(paras.where(F.length("text") >= 25).select("page_id", "box_seq"), ["page_id", "box_seq"], "left_semi").join(head, keys),
            F.concat(F.lit("/abs-"), "paragraph", F.lit("-"), "mark"),
            F.concat("paragraph", F.lit(" Buchstabe "), "mark"),
            "text",
            F.col("seq"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def annex_units(nodes: DataFrame, act: Column) -> DataFrame:
    """Annexes, their points grouped by section headings, and nested points."""
    nodes = nodes if "up" in nodes.columns else partition_by_page(nodes)
    ctx = enclosing(nodes, "div", r"^anx_[IVXLC]+$", "anx", 5).where("anx IS NOT NULL")
    titles = ctx.where(has_class("oj-doc-ti"))
    in_annex = W.partitionBy("page_id", "anx.seq").orderBy("seq")
    second = (
        titles.withColumn("_n", F.row_number().over(in_annex))
        .where("_n = 2")
        .select("page_id", F.col("anx.seq").alias("anx_seq"), F.col("text").alias("title"))
    )
    bodies = (
        ctx.where((F.col("seq") == F.col("anx.seq")) & (F.length("text") >= 60))
        .select("page_id", F.col("anx.seq").alias("anx_seq"), F.col("anx.value").alias("number"), "text")
        .join(second, ["page_id", "anx_seq"], "left")
        .withColumn("title", F.coalesce("title", F.lit("")))
    )
    points = annex_points(ctx)
    missing = bodies.join(points.select("page_id", "anx_seq").distinct(), ["page_id", "anx_seq"], "left_anti")
    pattern = r"(?md)^\s*(\d{1,2})\.\s+"
    pieces = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("mark"),
        F.transform(
            let(F.split("text", pattern, -1), lambda p: F.slice(p, F.lit(2), F.size(p))), lambda t: normalise_space(t)
        ).alias("text"),
    )
    split = missing.select("page_id", "anx_seq", F.posexplode(pieces).alias("i", "p")).where(
        F.length("p.text") > 60
    )
    all_points = points.unionByName(
        split.select(
            "page_id", "anx_seq", (F.col("anx_seq") + F.col("i")).alias("seq"), "p.mark", "p.text"
        )
    )
    stem = F.concat(act, F.lit("/anh-"), F.col("number"))

    def unit(df: DataFrame, suffix: Column, paragraph: Column, seq: Column) -> DataFrame:
        return df.select(
            "page_id",
            act.alias("act"),
            F.concat(stem, suffix).alias("unit_key"),
            F.lit(K.KIND_ANNEX).alias("kind"),
            "number",
            paragraph.cast("string").alias("paragraph"),
            "title",
            F.lit("").alias("chapter"),
            F.lit("").alias("section"),
            "text",
            _ord(2, F.col("anx_seq"), seq).alias("ord"),
        )

    return unit(bodies, F.lit(""), F.lit(None), F.lit(-1)).unionByName(
        unit(
            all_points.join(bodies.drop("text"), ["page_id", "anx_seq"]),
            F.concat(F.lit("/nr-"), "mark"),
            F.col("mark"),
            F.col("seq"),
        )
    )


def annex_points(ctx: DataFrame) -> DataFrame:
    """(page_id, anx_seq, seq, mark, text): points and their sub-points, level by level to the last.

    A heading that names a section sets it for the points after it; headings that do not match
    leave it as it is.
    """
    heading = has_class(r"oj-ti-grseq\S*") & (F.col("tag") == "p") & (F.col("parent_seq") == F.col("anx.seq"))
    pattern = r"^(?:Abschnitt\s+([A-Z]|\d{1,2})\b|(\d{1,2})\.\s+\S)"
    named = F.coalesce(
        F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")),
        F.nullif(F.regexp_extract("text", pattern, 2), F.lit("")),
    )
    order = W.partitionBy("page_id", "anx.seq").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    carrying = ctx.where(heading | (F.col("tag") == "table"))
    grouped = carrying.withColumn("group", F.last(F.when(heading, named), ignorenulls=True).over(order))
    items = item_tables(grouped).where("text_cell IS NOT NULL").select(
        "page_id",
        F.col("anx.seq").alias("anx_seq"),
        "parent_seq",
        "seq",
        "label",
        "text_cell",
        "group",
        without_label(F.col("text"), F.col("label")).alias("text"),
    )
    items = cut_lineage(items, "items")
    level = items.where(
        (F.col("parent_seq") == F.col("anx_seq")) & F.col("label").rlike(r"^(?:\d{1,2}|[a-z]|[ivxlc]+|[A-Z])$")
    ).select(
        "page_id", "anx_seq", "seq", "text_cell", F.concat_ws("-", "group", "label").alias("mark"), "text"
    )
    found = [level.where(F.length("text") > 60)]
    while True:
        above = level.select("page_id", F.col("text_cell").alias("parent_seq"), F.col("mark").alias("_above"))
        level = (
            items.where(F.col("label").rlike(r"^(?:[a-z]|[ivxlc]+)$") & (F.length("text") > 40))
            .join(above, ["page_id", "parent_seq"])
            .select("page_id", "anx_seq", "seq", "text_cell", F.concat_ws("-", "_above", "label").alias("mark"), "text")
        )
        level = cut_lineage(level, "level")
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, [f.drop("text_cell") for f in found])


def recital_units(nodes: DataFrame, act: Column) -> DataFrame:
    """Recitals of at least 40 characters without their leading count."""
    number = F.regexp_extract("node_id", r"^rct_(\d+)$", 1)
    lead = F.concat(F.lit(r"^\("), number, F.lit(r"\)\s*"))
    return (
        nodes.where(_is_id(r"^rct_\d+$"))
        .select(
            "page_id",
            act.alias("act"),
            F.concat(act, F.lit("/erw-"), number).alias("unit_key"),
            F.lit(K.KIND_RECITAL).alias("kind"),
            number.alias("number"),
            F.lit(None).cast("string").alias("paragraph"),
            F.concat(F.lit("Erwägungsgrund "), number).alias("title"),
            F.lit("").alias("chapter"),
            F.lit("").alias("section"),
            F.trim(F.regexp_replace("text", lead, "")).alias("text"),
            _ord(3, F.col("seq"), F.col("seq")).alias("ord"),
        )
        .where(F.length("text") >= 40)
    )


def statute_units(nodes: DataFrame, act: str = K.ACT_BDSG) -> DataFrame:
    """§ units of a statute page: parts and chapters only set context, independently of each other."""
    ctx = enclosing_before(partition_by_page(nodes), has_class("jnnorm"), "norm", F.lit("")).where("norm IS NOT NULL")
    ctx = enclosing_before(ctx, has_class("jnhtml"), "body", F.lit(""))

    def first(test: Column) -> Column:
        return F.min_by(F.when(test, F.col("text")), F.when(test, F.col("seq")))

    absatz = F.when(has_class("jurAbsatz") & F.col("body").isNotNull(), F.struct("seq", "text"))
    norms = ctx.groupBy("page_id", F.col("norm.seq").alias("norm_seq")).agg(
        F.coalesce(first(has_class("jnenbez")), F.lit("")).alias("name"),
        F.coalesce(first(has_class("jnentitel")), F.lit("")).alias("title"),
        first(has_class("jnhtml")).alias("html_text"),
        F.array_sort(F.collect_list(absatz)).alias("absaetze"),
    )
    heading = F.trim(F.concat_ws(" ", "name", "title"))
    order = W.partitionBy("page_id").orderBy("norm_seq").rowsBetween(W.unboundedPreceding, 0)
    carried = norms.select(
        "*",
        F.coalesce(F.last(F.when(F.startswith("name", F.lit("Teil")), heading), ignorenulls=True).over(order), F.lit("")).alias("chapter"),
        F.coalesce(
            F.last(F.when(F.col("name").rlike("^(?:Kapitel|Abschnitt|Unterabschnitt)"), heading), ignorenulls=True).over(order),
            F.lit(""),
        ).alias("section"),
        F.regexp_extract("name", r"^§\s*(\d+[a-z]?)$", 1).alias("number"),
    )
    text = F.when(
        F.size("absaetze") > 0, F.array_join(F.transform("absaetze", lambda a: a["text"]), "\n\n")
    ).otherwise(F.col("html_text"))
    bodies = (
        carried.where("number <> '' AND html_text IS NOT NULL")
        .withColumn("text", normalise_space(text))
        .where(F.length("text") >= 40)
    )
    stem = F.concat(F.lit(act + "/par-"), F.col("number"))
    common = ["number", "title", "chapter", "section"]
    whole = bodies.select(
        "page_id", F.lit(act).alias("act"), stem.alias("unit_key"), F.lit(K.KIND_PARAGRAPH).alias("kind"),
        F.lit(None).cast("string").alias("paragraph"), *common, "text",
        _ord(1, F.col("norm_seq"), F.lit(-1)).alias("ord"),
    )
    pieces = bodies.select(
        "page_id", *common, "norm_seq", F.posexplode(count_marker_split(F.col("text"))).alias("i", "p")
    )
    parts = pieces.select(
        "page_id", F.lit(act).alias("act"), F.concat(stem, F.lit("/abs-"), F.col("p.count")).alias("unit_key"),
        F.lit(K.KIND_PARAGRAPH).alias("kind"), F.col("p.count").alias("paragraph"), *common,
        F.col("p.text").alias("text"), _ord(1, F.col("norm_seq"), F.col("i")).alias("ord"),
    )
    return whole.unionByName(parts).select(*UNIT_COLUMNS)


def regulation_units(nodes: DataFrame, act: str | Column) -> DataFrame:
    """All units of regulation pages, duplicates included; `ord` is the order of first-wins.

    Parsing is the costly step and many rules read its result, so the nodes and their context are
    written once. Where nodes know what is above them, those that no rule reads fall away before.
    """
    act = F.lit(act) if isinstance(act, str) else act
    nodes = ctx = unit_nodes(nodes.where(is_read()) if "up" in nodes.columns else nodes)
    return reduce(
        DataFrame.unionByName,
        [
            article_units(ctx, act).select(*UNIT_COLUMNS),
            annex_units(nodes, act).select(*UNIT_COLUMNS),
            recital_units(nodes, act).select(*UNIT_COLUMNS),
        ],
    )


def first_units(pages: DataFrame, act: str | Column) -> DataFrame:
    """The units of regulation pages (page_id, html), of those with one key the first in the order of pages.

    The first page of every key is found from keys alone, so no text is exchanged for units that do not win; then
    the units of the pages that won are made with their texts. A page's units depend on that page only.
    """
    order = ("page_id", "ord")
    keys = regulation_units(node_table(pages, wanted=may_be_read), act).select("unit_key", *order)
    first = cut_lineage(first_wins(keys, "unit_key", *order), "first")
    won = pages.join(checked_broadcast(first.select("page_id").distinct()), "page_id", "left_semi")
    units = regulation_units(node_table(won, wanted=may_be_read), act)
    return first_wins(lookup_join(units, first, ["unit_key", *order]), "unit_key", *order).select(*UNIT_COLUMNS)
