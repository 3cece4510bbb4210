"""Optional re-scoring of candidates by a pluggable pair scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.citations import label

MARK = "kreuzbewerter"

_scorers: dict[bytes, Callable] = {}


def loaded(load: Callable[[], Callable]) -> Callable:
    """The scorer `load` returns, loaded once in each worker process however many tasks and batches ask."""
    name = cloudpickle.dumps(load)
    if name not in _scorers:
        _scorers[name] = load()
    return _scorers[name]


def rescore(
    ranked: DataFrame,
    queries: DataFrame,
    units: DataFrame,
    load: Callable[[], Callable[[list[str], list[str]], list[float]]] | None,
    chars: int = 1_800,
) -> DataFrame:
    """Replace the score of cut candidates (≤ 30 per query) and re-order them.

    `load()` runs once per worker and returns a scorer (questions, texts) → scores. Without one the
    order stays as it is. The candidates are joined to the texts after the cut, so the scorer never
    sees a row that was cut.
    """
    if load is None:
        return ranked
    cited = label(*[F.col(c) for c in ("kind", "act", "number", "paragraph", "title")])
    texts = units.select("unit_key", F.concat_ws("\n", cited, F.substring("text", 1, chars)).alias("_text"))
    asked = queries.select("query_id", F.col("text").alias("_question"))
    pairs = texts.join(ranked, "unit_key").join(asked, "query_id")
    columns = ranked.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = loaded(load)
        for batch in batches:
            batch = batch.copy()
            batch["score"] = scorer(list(batch["_question"]), list(batch["_text"]))
            yield batch[columns]

    scored = pairs.select(*columns, "_question", "_text").mapInPandas(run, ranked.schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("unit_key"))
    return scored.withColumn("rank", F.row_number().over(order)).withColumn(
        "ways", F.array_sort(F.array_append("ways", F.lit(MARK)))
    )
