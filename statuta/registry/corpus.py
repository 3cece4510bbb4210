"""Corpus queries: pages to nodes to units, assembly, quality, sinks and the index store."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.operators import corpus, diff, quality
from statuta.operators import units as U
from statuta.registry.base import query
from statuta.registry.search import HYBRID_CTE
from statuta.registry.frames import BASE_CTE, UNITS_SQL, as_text, normalise_sql, quote, strip_sql, units
from statuta.session import cut_lineage, scratch
from statuta.sources import articles, corpus_io, index_io
from statuta.sources import pages as P
from statuta.tables import load

# ---- pages as given ---------------------------------------------------------------


def page_nodes(spark, sf):
    return P.node_table(load(spark, sf, "pages"))


def count_sql(tag: str) -> str:
    return f"len(regexp_extract_all(html, '<{tag}[ >]'))"


@query("s01_page_scan", "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, md5(html) AS digest FROM pages")
def s01(spark, sf):
    """Every page as a file of its own, read back whole; the text writer ends a file with a line feed."""
    path = scratch(spark, "seiten")
    load(spark, sf, "pages").select("page_id", "html").write.partitionBy("page_id").option("lineSep", "\n").text(path)
    html = F.regexp_replace("html", r"\n\z", "")
    return P.read_pages(spark, path).select(
        F.regexp_extract("page_id", r"page_id=(\d+)/", 1).cast("bigint").alias("page_id"),
        (F.col("bytes") - 1).alias("bytes"), F.md5(html.cast("binary")).alias("digest"))


@query("s02_size_gate", "SELECT page_id, strlen(html) >= 9000 AS accepted FROM pages")
def s02(spark, sf):
    return P.size_gate(load(spark, sf, "pages"), 9000).select("page_id", "accepted")


TAGS = ("p", "li", "a", "h1", "article", "br", "footer", "div")


@query("x01_page_nodes", "SELECT page_id, " + ", ".join(f"CAST({count_sql(t)} AS BIGINT) AS n_{t}" for t in TAGS) + " FROM pages")
def x01(spark, sf):
    """Element counts per page from the node table."""
    return page_nodes(spark, sf).groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in TAGS])


@query("x01_plain_page_units")
def x01_units(spark, sf):
    """Given pages through an anchor map: the article tag is article 1, its p children are paragraphs."""
    nodes = page_nodes(spark, sf)
    order = W.partitionBy("page_id", "tag").orderBy("seq")
    numbered = nodes.withColumn("_n", F.row_number().over(order))
    named = P.rename_anchors(numbered, [("tag = 'article'", "'art_1'"), ("tag = 'p'", "concat('001.', lpad(_n, 3, '0'))")])
    boxed = named.withColumn("tag", F.when(F.col("tag").isin("article", "p"), "div").otherwise(F.col("tag")))
    boxed = boxed.withColumn("class", F.when(F.col("tag") == "h1", "eli-title").otherwise(F.col("class"))).drop("_n")
    return U.article_units(cut_lineage(U.with_context(boxed), "context"), F.lit("SEITE")).select(
        "page_id", "unit_key", "title", F.length("text").cast("bigint").alias("chars"))


# ---- structured pages made from the documents: every construct the unit rules know ------------

ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
# six parts that together are the whole text; the last takes what the division leaves
SIXTH = "CAST(floor(length(text) / 6) AS INT)"
PIECE = {f"p{i}": f"substr(text, 1 + {i - 1} * {SIXTH}, {SIXTH})" for i in range(1, 6)}
PIECE["p6"] = f"substr(text, 1 + 5 * {SIXTH})"
NUMBER = "CAST(doc_id % 90 + 1 AS INT)"


def _cell(label: str, text: str) -> str:
    return f"<table><tr><td>{label}</td><td>{text}</td></tr></table>"


TEMPLATE = (
    '<html><head><title>x</title><style>p{{}}</style></head><body><div id="cpt_II"><p class="oj-ti-section-1">KAPITEL II</p>'
    '<div id="cpt_II.sct_1"><p class="oj-ti-grseq-1">{p6}</p><div id="art_{n}"><p class="oj-sti-art">Titel {n}</p>'
    '<div id="{n3}.001"><p class="oj-normal">(1)\xa0\xa0\xa0{p1}</p>' + _cell("a)", "{p1}") + _cell("b)", "{p2}") + _cell("a)", "{p3}") + _cell("c)", "{p4}")
    + '</div><div id="{n3}.002">(2) {p2}</div><div id="{n3}.003">(9) {p6}</div><div id="999.004">(4) {p3}</div></div></div></div>'
    '<script>var a = "<p>";</script><div id="art_95"><p class="oj-sti-art">Begriffe</p>' + _cell("1.", "{p1}") + _cell("2.", "{p6}") + "</div>"
    '<div id="art_96"><p class="oj-normal">{p4}</p><p class="oj-normal">{p5}</p></div>'
    '<div id="anx_III"><p class="oj-doc-ti">ANHANG III</p><p class="oj-doc-ti">Liste</p>'
    '<table><tr><td></td><td>1.</td><td>{p1} <table><tr><td>a)</td><td>{p2}<table><tr><td>i)</td><td>{p3}</td></tr></table></td></tr></table></td></tr></table>'
    '<p class="oj-ti-grseq-1">Abschnitt B — Rest</p>' + _cell("1.", "{p4}") + '<p class="oj-ti-grseq-1">ohne Zählung</p>' + _cell("2.", "{p5}") + "</div>"
    '<div id="rct_7"><p>(7) {p5}</p></div></body></html>'
)


def structured_pages(spark, sf):
    d = load(spark, sf, "documents").selectExpr(
        "doc_id AS page_id", *[f"{ESC.format(e)} AS {n}" for n, e in PIECE.items()],
        f"CAST({NUMBER} AS STRING) AS n", f"lpad(CAST({NUMBER} AS STRING), 3, '0') AS n3")
    parts, rest = [], TEMPLATE.replace("{{}}", "")
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), F.col(name)]
    return d.select("page_id", F.concat(*parts, F.lit(rest)).alias("html"))


def nodes(spark, sf):
    return P.node_table(structured_pages(spark, sf))


def context(spark, sf):
    return U.unit_nodes(nodes(spark, sf))


def all_units(spark, sf):
    return U.regulation_units(P.node_table(structured_pages(spark, sf), wanted=U.may_be_read), K.ACT_AI)


# what the template must give; a text chunk is stripped first, then its blanks are normalised
CHUNK = {n: normalise_sql(strip_sql(e)) for n, e in PIECE.items()}
SRC = "src AS MATERIALIZED (SELECT doc_id AS page_id, CAST(" + NUMBER + " AS VARCHAR) AS n, " + ", ".join(f"{e} AS {n}" for n, e in CHUNK.items()) + ", " + ", ".join(f"{e} AS r{n}" for n, e in PIECE.items()) + " FROM documents)"


def item(label: str, mark: str, text: str, more: int) -> str:
    return f"SELECT page_id, n, '{label}' AS label, '{mark}' AS mark, {text} AS text FROM src WHERE length({text}) > {more}"


def joined(*parts: str) -> str:
    return normalise_sql("array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: length(x) > 0), ' ')")


PARA1 = joined(f"{strip_sql(chr(39) + '(1)' + chr(39) + ' || chr(160) || chr(160) || chr(160) || rp1')}", "'a)'", "p1", "'b)'", "p2", "'a)'", "p3", "'c)'", "p4")
PARA_BODY = "trim(regexp_replace({0}, '^\\(?(\\d{{1,2}})\\)?\\.?\\s+', ''))"
LETTERS_SQL = f"""lt AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM (
    SELECT page_id, n, unnest(['a', 'b', 'a', 'c']) AS label, unnest([1, 2, 3, 4]) AS pos, unnest([p1, p2, p3, p4]) AS text FROM src) WHERE length(text) > 40),
  rp AS (SELECT page_id, min(pos) AS repeat FROM (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id, label ORDER BY pos) AS k FROM lt) WHERE k = 2 GROUP BY page_id),
  lm AS (SELECT lt.*, CASE WHEN repeat IS NULL OR pos < repeat THEN label ELSE 'ua' || CAST(1 + (SELECT count(*) FROM lt x WHERE x.page_id = lt.page_id AND x.pos BETWEEN repeat AND lt.pos
      AND x.label IN (SELECT label FROM lt y WHERE y.page_id = lt.page_id AND y.pos < repeat)) AS VARCHAR) || '-' || label END AS mark FROM lt LEFT JOIN rp USING (page_id))"""


@query("x02_article_units", f"WITH {SRC} SELECT page_id, 'KI-VO/art-' || n AS unit_key, 'KAPITEL II' AS chapter, p6 AS section, 'Titel ' || n AS title FROM src")
def x02(spark, sf):
    u = U.article_units(context(spark, sf), F.lit(K.ACT_AI))
    return u.where("paragraph IS NULL AND number < 95").select("page_id", "unit_key", "chapter", "section", "title")


@query("x03_paragraph_units", f"""WITH {SRC}, pp AS (SELECT page_id, n, '1' AS paragraph, {PARA_BODY.format(PARA1)} AS text FROM src
    UNION ALL SELECT page_id, n, '2', {PARA_BODY.format(joined(strip_sql("'(2) ' || rp2")))} FROM src
    UNION ALL SELECT page_id, n, '3', {joined(strip_sql("'(9) ' || rp6"))} FROM src
    UNION ALL SELECT page_id, '96', '1', array_to_string(list_filter([p4, p5], lambda x: length(x) > 0), chr(10) || chr(10)) FROM src)
    SELECT page_id, n AS number, paragraph, text FROM pp WHERE text <> '' AND n <> '95'""")
def x03(spark, sf):
    ctx = context(spark, sf)
    return U.paragraphs(ctx).join(U.article_bodies(ctx).select("page_id", "art_seq", "number"), ["page_id", "art_seq"]).where(
        "number <> '95'").select("page_id", "number", "paragraph", "text")


@query("x04_definition_units", f"WITH {SRC}, d AS (SELECT page_id, '1' AS paragraph, p1 AS text FROM src UNION ALL SELECT page_id, '2', p6 FROM src) SELECT * FROM d WHERE length(text) > 30")
def x04(spark, sf):
    return U.definitions(context(spark, sf)).select("page_id", "paragraph", "text")


@query("x05_letter_units", f"WITH {SRC}, {LETTERS_SQL} SELECT page_id, mark, text FROM lm")
def x05(spark, sf):
    ctx = context(spark, sf)
    return U.letters(ctx, U.paragraphs(ctx)).select("page_id", "mark", "text")


@query("w03_restart_counter", f"WITH {SRC}, {LETTERS_SQL} SELECT mark, CAST(count(*) AS BIGINT) AS n FROM lm GROUP BY mark")
def w03(spark, sf):
    ctx = context(spark, sf)
    return U.letters(ctx, U.paragraphs(ctx)).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


@query("x06_label_cells", f"""WITH {SRC} SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['a', 'b', 'a', 'c', '1', '2', '1', 'a', 'i', '1', '2']) AS label FROM src) GROUP BY label""")
def x06(spark, sf):
    return U.table_labels(nodes(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


ANNEX_SQL = f"""pt AS ({item('1', '1', joined('p1', "'a)'", 'p2', "'i)'", 'p3'), 60)} UNION ALL {item('a', '1-a', joined('p2', "'i)'", 'p3'), 40)}
    UNION ALL SELECT page_id, n, 'i', '1-a-i', p3 FROM src WHERE length(p3) > 40 AND length({joined('p2', "'i)'", 'p3')}) > 40
    UNION ALL {item('1', 'B-1', 'p4', 60)} UNION ALL {item('2', 'B-2', 'p5', 60)})"""


def annex(spark, sf):
    return U.annex_units(context(spark, sf), F.lit(K.ACT_AI))


@query("x07_annex_points", f"WITH {SRC}, {ANNEX_SQL} SELECT page_id, 'KI-VO/anh-III/nr-' || mark AS unit_key, text FROM pt")
def x07(spark, sf):
    return annex(spark, sf).where("paragraph IS NOT NULL").select("page_id", "unit_key", "text")


@query("x08_nested_points", f"WITH {SRC}, {ANNEX_SQL} SELECT page_id, mark FROM pt WHERE mark LIKE '1-%'")
def x08(spark, sf):
    return annex(spark, sf).where("paragraph LIKE '1-%'").select("page_id", F.col("paragraph").alias("mark"))


@query("w04_carry_forward", f"WITH {SRC}, {ANNEX_SQL} SELECT split_part(mark, '-', 1) AS grp, CAST(count(*) AS BIGINT) AS points FROM pt GROUP BY 1")
def w04(spark, sf):
    return annex(spark, sf).where("paragraph IS NOT NULL").groupBy(F.substring_index("paragraph", "-", 1).alias("grp")).agg(F.count(F.lit(1)).alias("points"))


@query("x09_recital_units", f"WITH {SRC} SELECT page_id, 'KI-VO/erw-7' AS unit_key, text FROM (SELECT page_id, trim(regexp_replace({joined(strip_sql(chr(39) + '(7) ' + chr(39) + ' || rp5'))}, '^\\(7\\)\\s*', '')) AS text FROM src) WHERE length(text) >= 40")
def x09(spark, sf):
    return U.recital_units(nodes(spark, sf), F.lit(K.ACT_AI)).select("page_id", "unit_key", "text")


@query("x10_ancestor_context", f"WITH {SRC} SELECT page_id, 'KAPITEL II' AS chapter, p6 AS section FROM src")
def x10(spark, sf):
    return U.article_bodies(context(spark, sf)).where("section <> '' OR chapter <> ''").select("page_id", "chapter", "section")


# statute pages: parts and chapters in front of paragraphs, a new part keeps the old chapter
STATUTE = (
    '<div class="jnnorm"><span class="jnenbez">Teil 1</span><span class="jnentitel">Anfang</span></div>'
    '<div class="jnnorm"><span class="jnenbez">§ 1</span><span class="jnentitel">Erstes</span><div class="jnhtml"><div class="jurAbsatz">(1) {p1}</div><div class="jurAbsatz">(2) {p2}</div></div></div>'
    '<div class="jnnorm"><span class="jnenbez">Kapitel 1</span><span class="jnentitel">Mitte</span></div>'
    '<div class="jnnorm"><span class="jnenbez">§ 2a</span><span class="jnentitel">Zweites</span><div class="jnhtml">{p3}</div></div>'
    '<div class="jnnorm"><span class="jnenbez">Teil 2</span><span class="jnentitel">Ende</span></div>'
    '<div class="jnnorm"><span class="jnenbez">§ 3</span><span class="jnentitel">Drittes</span><div class="jnhtml"><div class="jurAbsatz">(1) {p4}</div></div></div>'
)


def statute_pages(spark, sf):
    d = load(spark, sf, "documents").selectExpr("doc_id AS page_id", *[f"{ESC.format(e)} AS {n}" for n, e in PIECE.items()])
    parts, rest = [], STATUTE
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), F.col(name)]
    return d.select("page_id", F.concat(*parts, F.lit(rest)).alias("html"))


NL2 = "chr(10) || chr(10)"
S1 = normalise_sql(f"{strip_sql(chr(39) + '(1) ' + chr(39) + ' || rp1')} || {NL2} || {strip_sql(chr(39) + '(2) ' + chr(39) + ' || rp2')}")


@query("x11_statute_units", f"""WITH {SRC}, w AS (SELECT page_id, '1' AS number, NULL AS paragraph, 'Teil 1 Anfang' AS chapter, '' AS section, {S1} AS text FROM src
      UNION ALL SELECT page_id, '2a', NULL, 'Teil 1 Anfang', 'Kapitel 1 Mitte', p3 FROM src
      UNION ALL SELECT page_id, '3', NULL, 'Teil 2 Ende', 'Kapitel 1 Mitte', {normalise_sql(strip_sql("'(1) ' || rp4"))} FROM src)
    SELECT page_id, 'BDSG/par-' || number AS unit_key, chapter, section, text FROM w WHERE length(text) >= 40""")
def x11(spark, sf):
    u = U.statute_units(P.node_table(statute_pages(spark, sf)))
    return u.where("paragraph IS NULL").select("page_id", "unit_key", "chapter", "section", "text")


# ---- nested article JSON, made from the documents -------------------------------------------

ART = {
    "einheit": "CASE WHEN doc_id % 9 = 0 THEN 'anhang' WHEN doc_id % 9 = 1 THEN 'erwaegungsgrund' ELSE 'artikel' END",
    "nummer": "CAST(doc_id AS STRING)", "titel": "lang", "quelle": "source",
}


def article_json(spark, sf):
    d = load(spark, sf, "documents").selectExpr("doc_id", "text AS body", *[f"{e} AS {n}" for n, e in ART.items()])
    para = lambda n, start, letters: F.struct(
        F.lit(n).alias("nummer"), F.expr(f"substr(body, {start})").alias("text"), letters.alias("buchstaben"))
    letter = lambda name, start: F.struct(F.lit(name).alias("buchstabe"), F.expr(f"substr(body, {start})").alias("text"))
    none = F.array().cast("array<struct<buchstabe:string,text:string>>")
    nested = F.array(para("1", 1, F.array(letter("a", 10), letter("b", 300))), para("2", 200, none))
    return d.select(
        *ART, F.lit("").alias("kapitel"), F.lit("").alias("abschnitt"),
        F.concat(F.lit("(1) "), F.col("body"), F.lit("\n(2) kurz")).alias("text"),
        F.when(F.col("doc_id") % 2 == 0, nested).alias("absaetze"), "doc_id")


def cut(start: int) -> str:
    return normalise_sql(f"substr(text, {start})")


@query("x13_nested_json", f"""WITH d AS (SELECT doc_id, {ART['einheit']} AS e, {cut(1)} AS p1, {cut(200)} AS p2, {cut(10)} AS la, {cut(300)} AS lb,
      {normalise_sql("'(1) ' || text || chr(10) || '(2) kurz'")} AS body, {cut(1)} AS m FROM documents),
    s AS (SELECT *, 'KI-VO/' || CASE e WHEN 'anhang' THEN 'anh-' WHEN 'erwaegungsgrund' THEN 'erw-' ELSE 'art-' END || CAST(doc_id AS VARCHAR) AS stem FROM d)
    SELECT stem AS unit_key, body AS text FROM s
    UNION ALL SELECT stem || '/abs-1', p1 FROM s WHERE e = 'artikel' AND doc_id % 2 = 0 AND length(p1) >= 25
    UNION ALL SELECT stem || '/abs-2', p2 FROM s WHERE e = 'artikel' AND doc_id % 2 = 0 AND length(p2) >= 25
    UNION ALL SELECT stem || '/abs-1-a', la FROM s WHERE e = 'artikel' AND doc_id % 2 = 0 AND length(p1) >= 25 AND length(la) >= 25
    UNION ALL SELECT stem || '/abs-1-b', lb FROM s WHERE e = 'artikel' AND doc_id % 2 = 0 AND length(p1) >= 25 AND length(lb) >= 25
    UNION ALL SELECT stem || '/abs-1', m FROM s WHERE e = 'artikel' AND doc_id % 2 = 1 AND length(m) > 25""")
def x13(spark, sf):
    return articles.article_rows(article_json(spark, sf), K.ACT_AI).select("unit_key", "text")


@query("s03_article_json_scan", "SELECT CAST(count(*) AS BIGINT) AS articles, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS nested FROM documents")
def s03(spark, sf):
    """Article files of up to fifty articles each, written from the documents and scanned back recursively."""
    path = scratch(spark, "artikel")
    rows = article_json(spark, sf)
    article = F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"]))
    files = rows.groupBy(F.pmod("doc_id", F.lit(4)).alias("teil"), F.floor(F.col("doc_id") / 200)).agg(F.collect_list(article).alias("alle"))
    text = F.concat(F.lit("[\n"), F.array_join("alle", ",\n"), F.lit("\n]"))
    files.select("teil", text.alias("value")).write.partitionBy("teil").option("maxRecordsPerFile", 1).text(path)
    # what a scan has to leave out: notes, the table of contents, and a file that is no JSON
    for name, text in (("_notiz.json", '{"einheit": "artikel"}'), (articles.CONTENTS_FILE, '{"einheit": "artikel"}'), ("kaputt.json", "{nein")):
        _put(spark, f"{path}/{name}", text)
    # the text writer names its files .txt
    return articles.read_articles(spark, path, "{*.json,part-*.txt}").agg(F.count(F.lit(1)).alias("articles"), F.count("absaetze").alias("nested"))


def _put(spark, path: str, text: str) -> None:
    """A small file in the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(text.encode()))
    out.close()


@query("s04_case_scan", "SELECT concat('fall/', CAST(doc_id AS VARCHAR)) AS unit_key, lang AS title FROM documents WHERE doc_id % 10 <> 3")
def s04(spark, sf):
    """Case files of up to fifty cases each; those without an id are skipped."""
    from statuta.sources.cases import case_units, read_cases

    path = scratch(spark, "faelle")
    fall = F.struct(
        F.when(F.col("doc_id") % 10 != 3, F.col("doc_id").cast("string")).alias("kennung"), F.col("lang").alias("titel"),
        F.col("text").alias("lage"))
    files = load(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 50)).agg(F.collect_list(fall).alias("faelle"))
    lines = F.array_join(F.transform("faelle", lambda f: F.to_json(f)), ",\n")
    files.select(F.concat(F.lit('{"faelle":[\n'), lines, F.lit("\n]}"))).write.option("maxRecordsPerFile", 1).text(path)
    return case_units(read_cases(spark, path)).select("unit_key", "title")


# part → a rule catalogue in its two tables, entries and their words
@query("s05_rule_catalogue", """SELECT p_brand AS rule_id, CAST(count(DISTINCT p_type) AS BIGINT) AS classes, CAST(count(DISTINCT w) AS BIGINT) AS words
    FROM (SELECT p_brand, p_type, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_brand""")
def s05(spark, sf):
    p = load(spark, sf, "part")
    rules = p.select(F.col("p_brand").alias("rule_id"), F.col("p_type").alias("class")).distinct()
    words = p.select(F.col("p_brand").alias("rule_id"), F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return rules.groupBy("rule_id").agg(F.count("class").alias("classes")).join(
        words.groupBy("rule_id").agg(F.count("word").alias("words")), "rule_id")


@query("s06_corpus_sink", f"WITH units AS ({UNITS_SQL}) SELECT act, CAST(count(*) AS BIGINT) AS units, CAST(sum(length(text)) AS BIGINT) AS chars FROM units GROUP BY act")
def s06(spark, sf):
    path = scratch(spark, "korpus")
    corpus_io.write_corpus(units(spark, sf).drop("doc_id"), path)
    return spark.read.schema("act STRING, text STRING").json(path).groupBy("act").agg(
        F.count(F.lit(1)).alias("units"), F.sum(F.length("text")).cast("bigint").alias("chars"))


BAD_KEY = "CASE WHEN doc_id % 17 = 0 THEN 'ohne-trenner' WHEN doc_id % 19 = 0 THEN 'KI-VO/art 5' WHEN doc_id % 23 = 0 THEN 'KI-VO/teil-5' ELSE unit_key END"
KEY_PROBLEM = r"""CASE WHEN k IS NULL OR length(k) < 3 THEN 'zu_kurz' WHEN length(k) > 120 THEN 'zu_lang' WHEN regexp_matches(k, '\s') THEN 'leerzeichen'
    WHEN NOT contains(k, '/') THEN 'ohne_trenner' WHEN NOT regexp_matches(k, '""" + "|".join(quality.KEY_FORMS) + "') THEN 'form' END"
KEYED = f"WITH units AS ({UNITS_SQL}), bad AS (SELECT {BAD_KEY} AS k, CASE WHEN doc_id % 29 = 0 THEN '' ELSE text END AS text, doc_id, source FROM units), j AS (SELECT *, {KEY_PROBLEM} AS problem FROM bad)"


def keyed(spark, sf):
    u = units(spark, sf)
    return u.withColumn("unit_key", F.expr(BAD_KEY)).withColumn("text", F.when(F.col("doc_id") % 29 == 0, "").otherwise(F.col("text")))


@query("s07_validated_source", KEYED + " SELECT CASE WHEN text = '' THEN 'text_leer' ELSE problem END AS reason, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1")
def s07(spark, sf):
    path = scratch(spark, "korpus")
    corpus_io.write_corpus(keyed(spark, sf).drop("doc_id"), path)
    valid, rejected = corpus_io.read_corpus(spark, path)
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(
        valid.agg(F.lit(None).cast("string").alias("reason"), F.count(F.lit(1)).alias("n")))


@query("v01_key_form", KEYED + " SELECT 'schluessel_' || problem AS rule, k AS subject FROM j WHERE problem IS NOT NULL")
def v01(spark, sf):
    return quality.key_findings(keyed(spark, sf))


MARKS = ("token = ", "Copyright")


@query("v02_row_checks", KEYED + f""" SELECT rule, k AS subject FROM (SELECT k, unnest(list_filter([CASE WHEN length(trim(text)) = 0 THEN 'text_leer' END,
      CASE WHEN length(text) BETWEEN 1 AND 99 THEN 'text_winzig' END, CASE WHEN {' OR '.join(f'contains(text, {quote(m)})' for m in MARKS)} THEN 'beiwerk' END,
      CASE WHEN source = 'src7' THEN 'ohne_quelle' END], lambda x: x IS NOT NULL)) AS rule FROM j)
    UNION ALL SELECT 'doppelt', k FROM j GROUP BY k HAVING count(*) > 1""")
def v02(spark, sf):
    u = keyed(spark, sf).withColumn("source", F.when(F.col("source") != "src7", F.col("source")))
    return quality.row_findings(u, MARKS, 100)


@query("v03_expected_counts", f"""WITH units AS ({UNITS_SQL}), c AS (SELECT kind, count(*) AS n FROM units GROUP BY kind), e AS (SELECT * FROM (VALUES ('artikel', 100), ('anhang', 0), ('paragraf', 250), ('gutachten', 5)) t(kind, expected))
    SELECT kind, CAST(coalesce(n, 0) AS BIGINT) AS found, CAST(expected AS BIGINT) AS expected FROM e LEFT JOIN c USING (kind) WHERE expected <> 0 AND coalesce(n, 0) <> expected""")
def v03(spark, sf):
    expected = spark.createDataFrame([("artikel", 100), ("anhang", 0), ("paragraf", 250), ("gutachten", 5)], "kind string, expected bigint")
    counts = units(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("units"))
    return quality.expected_counts(counts, expected, ["kind"])


COUNTS = f"WITH units AS ({UNITS_SQL})"


@query("s08_build_report", COUNTS + """, c AS (SELECT act, kind, count(*) AS n, sum(length(text)) AS chars FROM units GROUP BY ALL)
    SELECT '{"einheiten":' || CAST((SELECT sum(n) FROM c) AS VARCHAR) || ',"zeichen":' || CAST((SELECT CAST(sum(chars) AS BIGINT) FROM c) AS VARCHAR)
      || ',"je_rechtsakt":{' || (SELECT string_agg('"' || act || '":' || CAST(n AS VARCHAR), ',' ORDER BY act) FROM (SELECT act, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY act))
      || '},"je_art":{' || (SELECT string_agg('"' || kind || '":' || CAST(n AS VARCHAR), ',' ORDER BY kind) FROM (SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY kind)) || '}}' AS report""")
def s08(spark, sf):
    return corpus.build_report(units(spark, sf))


@query("a04_corpus_counts", COUNTS + " SELECT act, kind, CAST(count(*) AS BIGINT) AS units, CAST(sum(length(text)) AS BIGINT) AS chars FROM units GROUP BY act, kind")
def a04(spark, sf):
    return corpus.corpus_counts(units(spark, sf))


@query("a04_split_counts", f"""WITH {SRC}, {ANNEX_SQL}, {LETTERS_SQL} SELECT CAST(count(*) AS BIGINT) AS points FROM pt""")
def a04_split(spark, sf):
    return corpus.split_counts(all_units(spark, sf)).select(F.col("anhangspunkte").alias("points"))


@query("a16_newest_date", "SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS as_of FROM orders")
def a16(spark, sf):
    return load(spark, sf, "orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("as_of"))


# documents with their copies: the first 40 characters are the key, doc_id the order
HEAD = "text"


@query("w01_first_wins", f"SELECT {HEAD} AS head, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def w01(spark, sf):
    d = load(spark, sf, "documents").select(F.expr(HEAD).alias("head"), "doc_id")
    return corpus.first_wins(d, "head", "doc_id")


@query("a17_duplicate_report", f"SELECT {HEAD} AS head, CAST(count(*) - 1 AS BIGINT) AS dropped, count(DISTINCT text) = 1 AS same FROM documents GROUP BY 1 HAVING count(*) > 1")
def a17(spark, sf):
    return corpus.duplicate_report(load(spark, sf, "documents").select(F.expr(HEAD).alias("head"), "text"), "head")


@query("w01_units_of_all_pages")
def w01_units(spark, sf):
    """Every page repeats the same keys: hot keys with one row per page; the first page wins."""
    return U.first_units(structured_pages(spark, sf), K.ACT_AI).select("page_id", "unit_key", F.length("text").cast("bigint").alias("chars"))


# nation as the official source, customer as the fallback: acts are regions / segments
FALLBACK = """WITH o AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS unit_key, 'R' || CAST(n_regionkey AS VARCHAR) AS act FROM nation WHERE n_regionkey < 3),
    f AS (SELECT 'n' || CAST(c_custkey AS VARCHAR) AS unit_key, 'R' || CAST(c_nationkey % 5 AS VARCHAR) AS act FROM customer)"""


def two_sources(spark, sf):
    o = load(spark, sf, "nation").where("n_regionkey < 3").selectExpr("concat('n', n_nationkey) AS unit_key", "concat('R', n_regionkey) AS act")
    f = load(spark, sf, "customer").selectExpr("concat('n', c_custkey) AS unit_key", "concat('R', c_nationkey % 5) AS act")
    return o, f


@query("j05_source_precedence", FALLBACK + """ SELECT * FROM o UNION ALL SELECT * FROM f WHERE act NOT IN (SELECT act FROM o) AND unit_key NOT IN (SELECT unit_key FROM o)""")
def j05(spark, sf):
    return corpus.with_fallback(*two_sources(spark, sf))


@query("j06_key_complement", FALLBACK + " SELECT * FROM f WHERE unit_key NOT IN (SELECT unit_key FROM o)")
def j06(spark, sf):
    return corpus.complement(*two_sources(spark, sf))


@query("u01_union_of_sources", FALLBACK + ", a AS (SELECT * FROM o UNION ALL SELECT * FROM f) SELECT act, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY act")
def u01(spark, sf):
    return corpus.union_sources(*two_sources(spark, sf)).groupBy("act").agg(F.count(F.lit(1)).alias("n"))


@query("t06_corpus_order", COUNTS + " SELECT unit_key, row_number() OVER (PARTITION BY act ORDER BY unit_key) AS pos FROM units")
def t06(spark, sf):
    order = W.partitionBy("act").orderBy("unit_key")
    return units(spark, sf).select("unit_key", F.row_number().over(order).cast("bigint").alias("pos"))


@query("j07_citation_integrity", BASE_CTE + """, c AS (SELECT item_id, concat('KI-VO/art-', CAST(item_id % 120 + 1 AS VARCHAR)) AS unit_key FROM benchmark
      UNION ALL SELECT item_id, concat('BDSG/par-', CAST(item_id + 1 AS VARCHAR)) FROM benchmark) SELECT item_id, unit_key FROM c WHERE unit_key NOT IN (SELECT unit_key FROM units)""")
def j07(spark, sf):
    b = load(spark, sf, "benchmark").select("item_id", F.explode(F.array(
        F.concat(F.lit("KI-VO/art-"), (F.col("item_id") % 120 + 1).cast("string")),
        F.concat(F.lit("BDSG/par-"), (F.col("item_id") + 1).cast("string")))).alias("unit_key"))
    return quality.unresolved(b, units(spark, sf)).select("item_id", "unit_key")


@query("j08_parent_exists", COUNTS + r""", k AS (SELECT * FROM units WHERE doc_id % 7 <> 0) SELECT unit_key, regexp_extract(unit_key, '^([^/]+/[^/]+)', 1) AS stem FROM k
    WHERE len(string_split(unit_key, '/')) > 2 AND regexp_extract(unit_key, '^([^/]+/[^/]+)', 1) NOT IN (SELECT unit_key FROM k WHERE len(string_split(unit_key, '/')) = 2)""")
def j08(spark, sf):
    return quality.orphans(units(spark, sf).where("doc_id % 7 <> 0")).select("unit_key", "stem")


# orders → cases with a related case each: the next order of the same customer
RELATED = "SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS related, o_orderpriority FROM orders"


@query("j19_related_cases", f"WITH r AS ({RELATED}) SELECT r.o_orderkey, r.related, o.o_orderpriority AS priority FROM r JOIN orders o ON o.o_orderkey = r.related")
def j19(spark, sf):
    o = load(spark, sf, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    cases = o.select("o_orderkey", F.array_compact(F.array(F.lead("o_orderkey").over(w))).alias("verwandt"))
    links = cases.select("o_orderkey", F.explode("verwandt").alias("related"))
    return links.join(o.select(F.col("o_orderkey").alias("related"), F.col("o_orderpriority").alias("priority")), "related")


@query("j17_corpus_diff", """WITH a AS (SELECT doc_id AS k, text FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id AS k, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '!' END AS text FROM documents WHERE doc_id % 10 <> 2)
    SELECT k AS unit_key, CASE WHEN b.text IS NULL THEN 'only_left' WHEN a.text IS NULL THEN 'only_right' WHEN a.text = b.text THEN 'same' ELSE 'different' END AS status FROM a FULL JOIN b USING (k)""")
def j17(spark, sf):
    d = load(spark, sf, "documents").withColumnRenamed("doc_id", "unit_key")
    other = d.withColumn("text", F.when(F.col("unit_key") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))))
    return diff.corpus_diff(d.where("unit_key % 10 <> 1"), other.where("unit_key % 10 <> 2"))


# ---- index store ----------------------------------------------------------------------------


@query("s09_index_store", COUNTS + " SELECT 'hashing-256' AS model, CAST(count(*) AS BIGINT) AS units, CAST(count(*) AS BIGINT) AS vectors FROM units")
def s09(spark, sf):
    path = scratch(spark, "bestand")
    index_io.build_index(spark, units(spark, sf), path)
    stored = spark.read.parquet(f"{path}/vectors")
    return spark.read.parquet(f"{path}/manifest").select("model", "units", stored.agg(F.count(F.lit(1)).alias("n")).scalar().alias("vectors"))


@query("s10_guarded_load", """SELECT 'other corpus' AS case_name, TRUE AS refused UNION ALL SELECT 'other model', TRUE UNION ALL SELECT 'same', FALSE""")
def s10(spark, sf):
    """The stored index is refused for another model and for a corpus with one key changed."""
    path = scratch(spark, "bestand")
    u = units(spark, sf)
    index_io.build_index(spark, u, path)
    changed = u.withColumn("unit_key", F.when(F.col("doc_id") == 0, "fall/neu").otherwise(F.col("unit_key")))
    rows = []
    for name, live, model in (("same", u, "hashing-256"), ("other model", u, "anderes"), ("other corpus", changed, "hashing-256")):
        try:
            index_io.load_index(spark, path, live, model)
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "case_name string, refused boolean")


@query("u05_key_sequence", COUNTS + """ SELECT unit_key, 'stored' AS side FROM units WHERE doc_id % 50 = 1 UNION ALL SELECT unit_key || 'x', 'live' FROM units WHERE doc_id % 50 = 1""")
def u05(spark, sf):
    u = units(spark, sf)
    live = u.withColumn("unit_key", F.when(F.col("doc_id") % 50 == 1, F.concat("unit_key", F.lit("x"))).otherwise(F.col("unit_key")))
    return index_io.key_differences(u, live)


@query("s14_resumable_compute", COUNTS + """ SELECT unit_key, md5(text) AS content FROM units WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""")
def s14(spark, sf):
    """Two thirds are written, a fifth of all texts has changed since: what is still to compute."""
    u = units(spark, sf)
    path = scratch(spark, "vektoren")
    old = u.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, "alt").otherwise(F.col("text")))
    old.select("unit_key", index_io.content_hash().alias("content"), F.lit("m").alias("model")).write.parquet(path)
    return index_io.pending(u, spark.read.parquet(path), "m").select("unit_key", "content")


@query(
    "h09_index_build_and_probe",
    HYBRID_CTE + " SELECT query_id, CAST(place AS BIGINT) AS place, unit_key, act, kind, round(score, 6) AS score, ways FROM capped",
)
def h09(spark, sf):
    """Build, load behind the guard, and search on the stored index alone; equal to the search without one."""
    from statuta.plans.search import hybrid_search, indexed
    from statuta.registry.frames import questions

    path = scratch(spark, "bestand")
    u, q = units(spark, sf), questions(spark, sf)
    index_io.build_index(spark, u, path)
    index = index_io.load_index(spark, path, u, "hashing-256")
    return hybrid_search(u, q, **indexed(index, q)).select(
        "query_id", F.col("place").cast("bigint").alias("place"), "unit_key", "act", "kind", F.round("score", 6).alias("score"), as_text("ways")
    )


@query("e09_inventory", COUNTS + """ SELECT act, CAST(count(*) AS BIGINT) AS units, count(*) < 100 AS thin, '256' AS dimensions FROM units GROUP BY act""")
def e09(spark, sf):
    from statuta.operators.measure import inventory

    u = units(spark, sf)
    return inventory(u, index_io.manifest(u, "hashing-256", 256), 100)


@query("v04_catalogue_checks", """WITH e AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS entry, CASE WHEN p_size % 17 = 0 THEN '' ELSE p_type END AS class, p_brand AS rule, p_partkey FROM part),
    l AS (SELECT entry, substr(entry, 1, 4) AS text FROM e WHERE p_partkey % 11 <> 0), r AS (SELECT DISTINCT p_type AS class, p_brand AS rule FROM part WHERE p_size % 5 <> 0)
    SELECT 'feld_fehlt' AS rule_id, entry AS subject FROM e WHERE class = '' UNION ALL SELECT 'ohne_zweck', entry FROM e WHERE entry NOT IN (SELECT entry FROM l)
    UNION ALL SELECT 'satz_doppelt', min(entry) FROM l GROUP BY text HAVING count(*) > 1
    UNION ALL SELECT 'regel_unbekannt', entry FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.class = e.class AND r.rule = e.rule)""")
def v04(spark, sf):
    p = load(spark, sf, "part")
    e = p.select(F.concat(F.lit("p"), "p_partkey").alias("entry"), F.when(F.col("p_size") % 17 == 0, "").otherwise(F.col("p_type")).alias("class"), F.col("p_brand").alias("rule"), "p_partkey")
    lines = e.where("p_partkey % 11 <> 0").select("entry", F.substring("entry", 1, 4).alias("text"))
    rules = p.where("p_size % 5 <> 0").select(F.col("p_type").alias("class"), F.col("p_brand").alias("rule")).distinct()
    return quality.catalogue_findings(e, lines, rules)


FIELD = "concat(w, '_', CAST(p_size AS STRING))"


@query("v06_field_reachability", f"""WITH f AS (SELECT DISTINCT p_brand AS rule, {FIELD} AS field, p_type FROM (SELECT p_brand, p_size, p_type, unnest(string_split(p_name, ' ')) AS w FROM part))
    SELECT DISTINCT rule, field FROM f WHERE field NOT IN (SELECT field FROM f WHERE p_type = 'ECONOMY')""")
def v06(spark, sf):
    p = load(spark, sf, "part").select("p_brand", "p_type", "p_size", F.explode(F.split("p_name", " ")).alias("w"))
    fields = p.select(F.col("p_brand").alias("rule"), F.expr(FIELD).alias("field")).distinct()
    known = p.where("p_type = 'ECONOMY'").select(F.expr(FIELD).alias("field")).distinct()
    return quality.dead_fields(fields, known)
