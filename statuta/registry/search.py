"""Search queries: BM25, dense, sparse, citation lookup, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.citations import cited_keys
from statuta.functions.tokens import words
from statuta.operators import bm25, dense, encode, fusion, sparse
from statuta.operators.scale import lookup_join
from statuta.plans import search as plan
from statuta.registry.base import query
from statuta.registry.frames import (
    BASE_CTE,
    LABEL_SQL,
    SEARCH_SQL,
    as_text,
    bucket_sql,
    fold_ascii_sql,
    questions,
    quote,
    units,
    words_sql,
)
from statuta.tables import load

SEARCHED_CTE = f", searched AS (SELECT unit_key, {SEARCH_SQL} AS text FROM units)"
TOKENS_CTE = (
    BASE_CTE
    + f""",
searched AS (SELECT unit_key, {SEARCH_SQL} AS text FROM units),
ufold AS MATERIALIZED (SELECT unit_key, {fold_ascii_sql('text')} AS f FROM searched),
uwords AS MATERIALIZED (SELECT unit_key, {words_sql('f')} AS w FROM ufold),
qfold AS (SELECT query_id, {fold_ascii_sql('text')} AS f FROM questions),
qwords AS MATERIALIZED (SELECT DISTINCT query_id, word FROM
    (SELECT query_id, unnest({words_sql('f')}) AS word FROM qfold)),
tf AS MATERIALIZED (SELECT unit_key, word, count(*) AS tf FROM (SELECT unit_key, unnest(w) AS word FROM uwords)
    GROUP BY ALL),
doclen AS (SELECT unit_key, len(w) AS n FROM uwords),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
totals AS (SELECT count(*) AS units, sum(n) AS words, avg(n) AS avg_len FROM doclen)"""
)
SCORES_CTE = (
    TOKENS_CTE
    + """,
bm AS MATERIALIZED (SELECT query_id, unit_key, round(sum(ln(1 + (units - df + 0.5) / (df + 0.5)) * tf * 2.5
        / (tf + 1.5 * (0.25 + 0.75 * n / avg_len))), 9) AS score
    FROM qwords JOIN tf USING (word) JOIN df USING (word) JOIN doclen USING (unit_key) CROSS JOIN totals
    GROUP BY query_id, unit_key)"""
)
CITED_CTE = """,
pieces AS (SELECT query_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS pos, acts FROM (
    SELECT query_id, regexp_extract_all(text,
      '(?i)(?:Art(?:ikel)?\\.?\\s*\\d{1,3}(?:\\s*Abs(?:atz)?\\.?\\s*\\d{1,2})?(?:\\s*Buchst(?:abe)?\\.?\\s*[a-z])?|§\\s*\\d{1,3}[a-z]?|Anhang\\s*[IVXLC]+(?:\\s*(?:Nr\\.?|Nummer)\\s*\\d{1,2})?|Erw(?:ägungsgrund|aegungsgrund|G)?\\.?\\s*\\d{1,3})') AS p,
      CASE WHEN lower(text) LIKE '%bdsg%' OR lower(text) LIKE '%bundesdatenschutz%' THEN ['BDSG']
        WHEN lower(text) LIKE '%dsgvo%' OR lower(text) LIKE '%datenschutz-grundverordnung%' OR lower(text) LIKE '%gdpr%' THEN ['DSGVO']
        WHEN regexp_matches(lower(text), 'ki-vo|ki-verordnung|ai act|ai-act|kuenstliche intelligenz|künstliche intelligenz') THEN ['KI-VO']
        ELSE ['KI-VO', 'DSGVO'] END AS acts
    FROM questions)),
cited0 AS (SELECT query_id, pos, 0 AS sub, concat('BDSG/par-', regexp_extract(piece, '(\\d{1,3}[a-z]?)', 1)) AS k
    FROM pieces WHERE piece LIKE '§%'
  UNION ALL SELECT query_id, pos, 0, concat('KI-VO/anh-', upper(regexp_extract(piece, '(?i)Anhang\\s*([IVXLC]+)', 1)),
      CASE WHEN regexp_matches(piece, '\\d') THEN concat('/nr-', regexp_extract(piece, '(\\d+)', 1)) ELSE '' END)
    FROM pieces WHERE lower(piece) LIKE 'anhang%'
  UNION ALL SELECT query_id, pos, sub, concat(acts[sub], '/erw-', regexp_extract(piece, '(\\d+)', 1))
    FROM (SELECT *, unnest(generate_series(1, len(acts))) AS sub FROM pieces WHERE lower(piece) LIKE 'erw%')
  UNION ALL SELECT query_id, pos, sub, concat(acts[sub], '/art-', regexp_extract(piece, '(\\d+)', 1),
      CASE WHEN regexp_matches(piece, '(?i)Abs') THEN concat('/abs-', regexp_extract(piece, '(?i)Abs(?:atz)?\\.?\\s*(\\d+)', 1),
        CASE WHEN regexp_matches(piece, '(?i)Buchst') THEN concat('-', lower(regexp_extract(piece, '(?i)Buchst(?:abe)?\\.?\\s*([a-z])', 1))) ELSE '' END)
      ELSE '' END)
    FROM (SELECT *, unnest(generate_series(1, len(acts))) AS sub FROM pieces WHERE lower(piece) LIKE 'art%')),
cited AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, sub) - 1 AS pos, k FROM cited0),
cite_hit AS (SELECT c.query_id, c.pos, coalesce(u.unit_key, p.unit_key) AS unit_key,
      CASE WHEN u.unit_key IS NOT NULL THEN 1.0 ELSE 0.9 END AS score
    FROM cited c LEFT JOIN units u ON u.unit_key = c.k
      LEFT JOIN units p ON p.unit_key = regexp_replace(c.k, '/[^/]*$', '')
    WHERE coalesce(u.unit_key, p.unit_key) IS NOT NULL),
cite_rank AS (SELECT query_id, unit_key, score, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank
    FROM cite_hit)"""


def hashed_cte(name: str, key: str, source: str) -> str:
    return f""",
{name}_b AS MATERIALIZED (SELECT {key}, {bucket_sql('w')} AS b, count(*) AS n FROM (
    SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) > 0)) AS w FROM {source})
    GROUP BY ALL),
{name}_v AS MATERIALIZED (SELECT {key}, b, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM {name}_b)"""


DENSE_CTE = (
    hashed_cte("uh", "unit_key", "searched")
    + hashed_cte("qh", "query_id", "questions")
    + """,
dn0 AS (SELECT query_id, unit_key, round(sum(q.x * u.x), 9) AS score FROM qh_v q JOIN uh_v u USING (b)
    GROUP BY query_id, unit_key),
dn AS (SELECT q.query_id, u.unit_key, coalesce(d.score, 0) AS score FROM questions q CROSS JOIN units u
    LEFT JOIN dn0 d ON d.query_id = q.query_id AND d.unit_key = u.unit_key)"""
)
SPARSE_CTE = """,
usp AS (SELECT unit_key, word AS token, tf / sum(tf) OVER (PARTITION BY unit_key) AS weight FROM tf),
qsp AS (SELECT query_id, word AS token, 1.0 / count(*) OVER (PARTITION BY query_id) AS weight FROM qwords),
sp AS MATERIALIZED (SELECT * FROM (SELECT query_id, unit_key, round(sum(u.weight * q.weight), 9) AS score
    FROM usp u JOIN qsp q USING (token) GROUP BY query_id, unit_key) WHERE score > 0)"""


def top_sql(source: str, k: int) -> str:
    return (
        f"(SELECT query_id, unit_key, score, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY score DESC, unit_key) AS rank FROM {source} QUALIFY rank <= {k})"
    )


HYBRID_CTE = (
    SCORES_CTE
    + CITED_CTE
    + DENSE_CTE
    + SPARSE_CTE
    + f""",
ways AS MATERIALIZED (SELECT query_id, unit_key, rank, 'fundstelle' AS way, 3.0 AS w FROM cite_rank
  UNION ALL SELECT query_id, unit_key, rank, 'stichwort', 1.0 FROM {top_sql('bm', 50)}
  UNION ALL SELECT query_id, unit_key, rank, 'vektor', 1.0 FROM {top_sql('dn', 50)}
  UNION ALL SELECT query_id, unit_key, rank, 'wortgewichte', 1.0 FROM {top_sql('sp', 50)}),
fused AS MATERIALIZED (SELECT query_id, unit_key, round(sum(w / (60.0 + rank)), 9) AS score,
    string_agg(DISTINCT way, '|' ORDER BY way) AS ways,
    max(CASE WHEN way = 'fundstelle' THEN rank END) AS rank_fundstelle,
    max(CASE WHEN way = 'vektor' THEN rank END) AS rank_vektor,
    max(CASE WHEN way = 'stichwort' THEN rank END) AS rank_stichwort,
    max(CASE WHEN way = 'wortgewichte' THEN rank END) AS rank_wortgewichte
    FROM ways GROUP BY query_id, unit_key),
cut AS MATERIALIZED (SELECT f.*, u.act, u.kind, row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, unit_key) AS rank
    FROM fused f JOIN units u USING (unit_key) QUALIFY rank <= 30),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS place FROM (
    SELECT *, kind = 'fallbeispiel' AND row_number() OVER (PARTITION BY query_id, kind = 'fallbeispiel' ORDER BY rank) > 2 AS late
    FROM cut) QUALIFY place <= 8)"""
)


def _ways(spark, sf):
    """All four ranked lists over the stand-in corpus."""
    u, q = units(spark, sf), questions(spark, sf)
    return u, q, plan.from_texts(u, q)


def _fused(spark, sf):
    u, q, vectors = _ways(spark, sf)
    return u, plan.fused_ways(u, q, **vectors)


def _cut(spark, sf, acts=()):
    u, fused = _fused(spark, sf)
    return fusion.candidate_cut(lookup_join(u.select("unit_key", "act", "kind"), fused, ["unit_key"]), 8, acts)


SCORE = F.round("score", 5).alias("score")


@query(
    "x15_search_words",
    TOKENS_CTE
    + " SELECT unit_key, CAST(len(w) AS BIGINT) AS n, array_to_string(list_sort(w), ' ') AS words FROM uwords",
)
def x15(spark, sf):
    w = words(F.col("text"))
    return plan.searchable(units(spark, sf)).select(
        "unit_key", F.size(w).cast("bigint").alias("n"), F.array_join(F.array_sort(w), " ").alias("words")
    )


@query(
    "x16_cited_keys",
    BASE_CTE + CITED_CTE + " SELECT query_id, CAST(pos AS BIGINT) AS pos, k AS cited FROM cited",
)
def x16(spark, sf):
    return questions(spark, sf).select(
        "query_id", F.posexplode(cited_keys(F.col("text"))).alias("pos", "cited")
    ).select("query_id", F.col("pos").cast("bigint").alias("pos"), "cited")


@query(
    "a01_term_statistics",
    TOKENS_CTE
    + """ SELECT word, CAST(sum(tf) AS BIGINT) AS tf, CAST(count(*) AS BIGINT) AS df,
    CAST(max(n) AS BIGINT) AS longest FROM tf JOIN doclen USING (unit_key) GROUP BY word""",
)
def a01(spark, sf):
    tf = bm25.text_statistics(plan.searchable(units(spark, sf))).term_frequency()
    return tf.groupBy("word").agg(
        F.sum("tf").alias("tf"), F.count("tf").alias("df"), F.max("len").cast("bigint").alias("longest")
    )


@query(
    "a01_corpus_totals",
    TOKENS_CTE
    + " SELECT CAST(units AS BIGINT) AS units, CAST(words AS BIGINT) AS words, round(avg_len, 6) AS avg_len FROM totals",
)
def a01_totals(spark, sf):
    return bm25.text_statistics(plan.searchable(units(spark, sf))).totals.select(
        "units", "words", F.round("avg_len", 6).alias("avg_len")
    )


@query(
    "j01_postings_lookup",
    TOKENS_CTE
    + """ SELECT query_id, word, CAST(count(*) AS BIGINT) AS units, CAST(sum(tf) AS BIGINT) AS tf
    FROM qwords JOIN tf USING (word) GROUP BY query_id, word""",
)
def j01(spark, sf):
    tf = bm25.text_statistics(plan.searchable(units(spark, sf))).term_frequency()
    return (
        lookup_join(tf.select("word", "tf"), bm25.query_words(questions(spark, sf)), ["word"])
        .groupBy("query_id", "word")
        .agg(F.count(F.lit(1)).alias("units"), F.sum("tf").alias("tf"))
    )


@query("a02_bm25_score", SCORES_CTE + " SELECT query_id, unit_key, round(score, 5) AS score FROM bm")
def a02(spark, sf):
    u, q = plan.searchable(units(spark, sf)), questions(spark, sf)
    return bm25.bm25_scores(bm25.asked_statistics(u, q), q).withColumn("score", SCORE)


@query(
    "h01_bm25_search",
    SCORES_CTE + f" SELECT query_id, unit_key, round(score, 5) AS score, rank FROM {top_sql('bm', 50)}",
)
def h01(spark, sf):
    return bm25.bm25_search(plan.searchable(units(spark, sf)), questions(spark, sf)).select(
        "query_id", "unit_key", SCORE, F.col("rank").cast("bigint").alias("rank")
    )


CENTROIDS = """cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) AS i FROM embeddings),
centroids AS (SELECT label, list(m ORDER BY i) AS q FROM
    (SELECT label, i, avg(x) AS m FROM cells GROUP BY label, i) GROUP BY label)"""


def label_centroids(spark, sf):
    """Mean vector per label, as the query side of the dense search."""
    cells = load(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("embedding")
    ).withColumnRenamed("label", "query_id")


@query(
    "h02_dense_search",
    f"""WITH {CENTROIDS} SELECT CAST(label AS BIGINT) AS query_id, vec_id AS unit_key, round(s, 5) AS score, rank
    FROM (SELECT c.label, e.vec_id, round(list_dot_product(c.q, e.embedding::DOUBLE[]), 9) AS s,
      row_number() OVER (PARTITION BY c.label ORDER BY round(list_dot_product(c.q, e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
      FROM centroids c CROSS JOIN embeddings e) WHERE rank <= 50""",
)
def h02(spark, sf):
    vectors = load(spark, sf, "embeddings").withColumnRenamed("vec_id", "unit_key")
    return dense.dense_search(vectors, label_centroids(spark, sf)).select(
        F.col("query_id").cast("bigint").alias("query_id"),
        "unit_key",
        SCORE,
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "j02_dense_similarity",
    BASE_CTE
    + SEARCHED_CTE
    + DENSE_CTE
    + f" SELECT query_id, unit_key, round(score, 5) AS score, rank FROM {top_sql('dn', 50)}",
)
def j02(spark, sf):
    u, q = units(spark, sf), questions(spark, sf)
    return dense.dense_search(
        encode.hashing_dense(plan.searchable(u), "unit_key", "text"), encode.hashing_dense(q, "query_id", "text")
    ).select("query_id", "unit_key", SCORE, F.col("rank").cast("bigint").alias("rank"))


@query(
    "h06_hashing_encoder",
    BASE_CTE
    + hashed_cte("uh", "unit_key", "units")
    + " SELECT unit_key, b AS bucket, round(x, 6) AS weight FROM uh_v",
)
def h06(spark, sf):
    return encode.hashing_encode(units(spark, sf), "unit_key", "text").select(
        "unit_key", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight")
    )


@query(
    "h07_pluggable_encoder",
    BASE_CTE
    + """ SELECT query_id, CAST(length('frage: ' || text) AS BIGINT) AS chars,
    round(length('frage: ' || text) / sqrt(length('frage: ' || text) * length('frage: ' || text) + 1.0), 6) AS first
    FROM questions""",
)
def h07(spark, sf):
    def load_model():
        import numpy as np

        return lambda texts: (
            np.array([[len(t), 1.0] for t in texts]),
            [{"chars": float(len(t))} for t in texts],
        )

    coder = encode.Encoder("laengen", 2, load_model, query_prefix="frage: ")
    return encode.encode(questions(spark, sf), "query_id", "text", coder, "query").select(
        "query_id",
        F.col("weights")["chars"].cast("bigint").alias("chars"),
        F.round(F.element_at("embedding", 1), 6).alias("first"),
    )


@query("j03_sparse_dot", TOKENS_CTE + SPARSE_CTE + " SELECT query_id, unit_key, round(score, 6) AS score FROM sp")
def j03(spark, sf):
    _, _, v = _ways(spark, sf)
    return sparse.sparse_scores(v["unit_weights"], v["query_weights"]).select(
        "query_id", "unit_key", F.round("score", 6).alias("score")
    )


@query(
    "h03_sparse_search",
    TOKENS_CTE + SPARSE_CTE + f" SELECT query_id, unit_key, round(score, 6) AS score, rank FROM {top_sql('sp', 50)}",
)
def h03(spark, sf):
    _, _, v = _ways(spark, sf)
    return sparse.sparse_search(v["unit_weights"], v["query_weights"]).select(
        "query_id", "unit_key", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "j04_citation_lookup",
    BASE_CTE + CITED_CTE + " SELECT query_id, CAST(pos AS BIGINT) AS pos, unit_key, CAST(score AS DOUBLE) AS score FROM cite_hit",
)
def j04(spark, sf):
    found = fusion.citation_candidates(questions(spark, sf)).join(
        units(spark, sf).select("unit_key"), "unit_key"
    )
    return found.groupBy("query_id", "pos").agg(
        F.max_by("unit_key", "score").alias("unit_key"), F.max("score").cast("double").alias("score")
    ).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "h04_citation_search",
    BASE_CTE + CITED_CTE + " SELECT query_id, unit_key, CAST(score AS DOUBLE) AS score, rank FROM cite_rank",
)
def h04(spark, sf):
    return fusion.citation_search(units(spark, sf), questions(spark, sf)).select(
        "query_id", "unit_key", F.col("score").cast("double").alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


RANKED_OUT = ("query_id", "unit_key", "way", "rank")


@query("u02_union_of_ways", HYBRID_CTE + " SELECT query_id, unit_key, way, CAST(rank AS BIGINT) AS rank FROM ways")
def u02(spark, sf):
    u, q, v = _ways(spark, sf)
    return fusion.union_ways(plan.ranked_ways(u, q, **v)).select(
        "query_id", "unit_key", "way", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "w02_rank_per_way",
    HYBRID_CTE
    + """ SELECT way, CAST(rank AS BIGINT) AS rank, CAST(count(*) AS BIGINT) AS queries, min(unit_key) AS least_key
    FROM ways GROUP BY way, rank""",
)
def w02(spark, sf):
    u, q, v = _ways(spark, sf)
    return (
        fusion.union_ways(plan.ranked_ways(u, q, **v))
        .groupBy("way", F.col("rank").cast("bigint").alias("rank"))
        .agg(F.count(F.lit(1)).alias("queries"), F.min("unit_key").alias("least_key"))
    )


@query(
    "t01_top50_per_way",
    HYBRID_CTE
    + """ SELECT query_id, way, CAST(count(*) AS BIGINT) AS n, CAST(max(rank) AS BIGINT) AS last_rank
    FROM ways GROUP BY query_id, way""",
)
def t01(spark, sf):
    u, q, v = _ways(spark, sf)
    return fusion.union_ways(plan.ranked_ways(u, q, **v)).groupBy("query_id", "way").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").cast("bigint").alias("last_rank")
    )


@query(
    "a03_rank_fusion",
    HYBRID_CTE
    + """ SELECT query_id, unit_key, round(score, 6) AS score, ways, rank_fundstelle, rank_vektor, rank_stichwort,
    rank_wortgewichte FROM fused""",
)
def a03(spark, sf):
    _, fused = _fused(spark, sf)
    ranks = [F.col(f"rank_{w}").cast("bigint").alias(f"rank_{w}") for w in K.WAY_WEIGHT]
    return fused.select("query_id", "unit_key", F.round("score", 6).alias("score"), as_text("ways"), *ranks)


@query(
    "p13_act_filter_after_fusion",
    HYBRID_CTE
    + """ SELECT query_id, unit_key, act, CAST(rank AS BIGINT) AS rank FROM (
    SELECT f.query_id, f.unit_key, u.act, row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, unit_key) AS rank
    FROM fused f JOIN units u USING (unit_key) WHERE u.act IN ('KI-VO', 'BDSG')) WHERE rank <= 30""",
)
def p13(spark, sf):
    return _cut(spark, sf, (K.ACT_AI, K.ACT_BDSG)).select(
        "query_id", "unit_key", "act", F.col("rank").cast("bigint").alias("rank")
    )


# questions with their own acts and number of hits: three kinds, one of them without either
OPTIONS_CTE = """, options AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN ['KI-VO', 'BDSG'] WHEN 1 THEN ['DSGVO'] ELSE ['KI-VO', 'DSGVO', 'BDSG', 'Leitlinie'] END AS acts,
    CASE query_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 12 ELSE 8 END AS n FROM questions),
ocut AS MATERIALIZED (SELECT f.*, u.act, u.kind, o.n, row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, unit_key) AS rank
    FROM fused f JOIN units u USING (unit_key) JOIN options o USING (query_id) WHERE list_contains(o.acts, u.act) QUALIFY rank <= 30),
ocap AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS place FROM (
    SELECT *, kind = 'fallbeispiel' AND row_number() OVER (PARTITION BY query_id, kind = 'fallbeispiel' ORDER BY rank) > greatest(1, n // 3) AS late
    FROM ocut) QUALIFY place <= n)"""


@query(
    "p13_options_per_query",
    HYBRID_CTE + OPTIONS_CTE + " SELECT query_id, CAST(place AS BIGINT) AS place, unit_key, act, round(score, 6) AS score FROM ocap",
)
def p13_options(spark, sf):
    u, q, vectors = _ways(spark, sf)
    third = F.col("query_id") % 3
    acts = F.when(third == 0, F.array(F.lit(K.ACT_AI), F.lit(K.ACT_BDSG))).when(third == 1, F.array(F.lit(K.ACT_GDPR)))
    asked = q.withColumn("acts", acts).withColumn("n", F.when(third == 0, 5).when(third == 1, 12))
    return plan.hybrid_search(u, asked, **vectors).select(
        "query_id", F.col("place").cast("bigint").alias("place"), "unit_key", "act", F.round("score", 6).alias("score")
    )


@query("t02_candidate_cut", HYBRID_CTE + " SELECT query_id, unit_key, CAST(rank AS BIGINT) AS rank FROM cut")
def t02(spark, sf):
    return _cut(spark, sf).select("query_id", "unit_key", F.col("rank").cast("bigint").alias("rank"))


@query(
    "w05_category_cap",
    HYBRID_CTE + " SELECT query_id, unit_key, kind, CAST(place AS BIGINT) AS place FROM capped",
)
def w05(spark, sf):
    return fusion.cap_cases(_cut(spark, sf), 8).select(
        "query_id", "unit_key", "kind", F.col("place").cast("bigint").alias("place")
    )


@query(
    "t03_final_hits",
    HYBRID_CTE
    + """ SELECT query_id, CAST(count(*) AS BIGINT) AS hits, string_agg(unit_key, '|' ORDER BY place) AS hit_keys
    FROM capped GROUP BY query_id""",
)
def t03(spark, sf):
    return fusion.cap_cases(_cut(spark, sf), 8).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "unit_key"))), lambda s: s.unit_key), "|"
        ).alias("hit_keys"),
    )


@query(
    "h05_hybrid_search",
    HYBRID_CTE
    + " SELECT query_id, CAST(place AS BIGINT) AS place, unit_key, act, kind, round(score, 6) AS score, ways FROM capped",
)
def h05(spark, sf):
    u, q, vectors = _ways(spark, sf)
    return plan.hybrid_search(u, q, **vectors).select(
        "query_id",
        F.col("place").cast("bigint").alias("place"),
        "unit_key",
        "act",
        "kind",
        F.round("score", 6).alias("score"),
        as_text("ways"),
    )


@query(
    "t07_rescore",
    HYBRID_CTE
    + """, rescored AS (SELECT c.query_id, c.unit_key, CAST((length(""" + LABEL_SQL + """) + 1 + length(substr(u.text, 1, 1800))) % 101 AS DOUBLE) AS s,
      row_number() OVER (PARTITION BY c.query_id ORDER BY s DESC, c.unit_key) AS rank
      FROM (SELECT query_id, unit_key FROM cut) c JOIN units u USING (unit_key))
    SELECT query_id, unit_key, s AS score, CAST(rank AS BIGINT) AS rank FROM rescored""",
)
def t07(spark, sf):
    from statuta.operators.rescore import rescore

    def load_scorer():
        return lambda asked, texts: [float(len(t) % 101) for t in texts]

    return rescore(_cut(spark, sf), questions(spark, sf), units(spark, sf), load_scorer).select(
        "query_id", "unit_key", "score", F.col("rank").cast("bigint").alias("rank")
    )
