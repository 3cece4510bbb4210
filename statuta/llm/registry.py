"""The queries of this package over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from statuta.llm import (
    centroids,
    html_extract,
    language_id,
    lm_score,
    maxscore,
    mixing,
    nearest,
    packing,
    secret_scan,
    sequence_files,
    simhash,
    token_counts,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


#: Shares of the tokens wanted of each domain.
MIXTURE = {"high": 0.9, "low": 0.1, "toxic": 0.0}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_lm_score")
def op1_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(table(spark, folder, "documents"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


@query("op3_mixing")
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Nine tenths of the tokens from documents of high quality, none from toxic ones."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return mixing.mixed(docs, labels, mixing.quality_domain(), MIXTURE)


@query("op4_html_extract")
def op4_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_text(table(spark, folder, "pages"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), VOCABULARY)


@query("op7_simhash_duplicates")
def op7_simhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), VOCABULARY)


VECTORS = "SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query(
    "op8_nearest",
    f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM ({VECTORS}) WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.e, c.e) score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
)
def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"))


@query(
    "op9_maxscore",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) e FROM ({VECTORS})),
    s AS (SELECT q.vec_id query_id, c.vec_id vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op9_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    return maxscore.top_scores(table(spark, folder, "embeddings"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, folder, "documents"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def _rounds(rounds: int) -> str:
    """Assignment and update as common table expressions, one pair for each round."""
    told = []
    for i in range(rounds + 1):
        told.append(
            f"""d{i} AS MATERIALIZED (SELECT v.row, v.vec_id, v.e, c.cluster,
            CAST(list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e) AS BIGINT) distance FROM v CROSS JOIN c{i} c),
            a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"""
        )
        if i < rounds:
            told.append(
                f"""p{i} AS (SELECT cluster, unnest(range(1, 65)) i, unnest(e) x FROM a{i}),
                m{i} AS (SELECT cluster, i, floor(sum(x) / count(*)) x FROM p{i} GROUP BY cluster, i),
                n{i} AS (SELECT cluster, list(x ORDER BY i) e FROM m{i} GROUP BY cluster),
                c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.e, c.e) e FROM c{i} c LEFT JOIN n{i} n USING (cluster))"""
            )
    return ", ".join(told)


@query(
    "op12_clusters",
    f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) e
        FROM ({VECTORS}) WHERE len(embedding) = 64),
    c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INT) AS cluster, e FROM v ORDER BY cluster LIMIT 16),
    {_rounds(3)},
    s AS (SELECT cluster, CAST(sum(distance) AS BIGINT) inertia FROM a3 GROUP BY cluster)
    SELECT a.vec_id, a.cluster, a.distance, s.inertia cluster_inertia, (SELECT CAST(sum(inertia) AS BIGINT) FROM s) inertia,
    sha256(array_to_string(list_transform(c.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) centroid_sha256
    FROM a3 a JOIN s USING (cluster) JOIN c3 c USING (cluster)""",
)
def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))


@query("op13_sequence_files")
def op13_sequence_files(spark: SparkSession, folder: str) -> DataFrame:
    return sequence_files.stored(table(spark, folder, "documents"), WORD_VOCABULARY)
