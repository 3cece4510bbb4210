"""Mixing of documents to target weights of domains they belong to only in part.

A classifier learnt from a labelled table gives each document a posterior over the domains. Nonnegative rates
(expected copies of a document) are then fitted so that the expected tokens of each domain meet the targets:
accelerated projected gradient on the least squares

    1/2 sum_k (sum_i r_i t_i p_ik / T - w_k)^2 / s_k + ridge/2 sum_i t_i/T (r_i - 1)^2,    r >= 0,

with tokens t, posteriors p, all tokens T, targets w and the domains' present shares s. Weighted by 1/s the
problem has its largest curvature at 1 and, where posteriors are sharp, hardly another one, so a few rounds do,
however small a domain is. One round is one pass over the posteriors, from which
only one residual per domain comes back. A document's rate follows from its posterior and the residuals so far,
so no rates are stored between the rounds, and a lost task is simply run again.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.features import ROOM, Finder, word_features
from statuta.llm.words import Memo, distinct_words, gathered, slices
from statuta.session import cut_lineage

#: Bounds of the training sample, in documents, and of the features chosen from it.
SAMPLE = 4000
FEATURES = 1500
RIDGE = 0.01
ROUNDS = 400
TOLERANCE = 1e-4
LEAST_SHARE = 1e-3

#: Texts that are judged together, as rows of a dense matrix of features.
TOGETHER = 256


def text_features(text: str | None, known: Memo) -> tuple[Counter, int]:
    """How often each feature occurs, with `= ` for a word that repeats the one before; and the words."""
    words = (text or "").split()
    count = Counter(chain.from_iterable(map(known.__getitem__, words)))
    again = sum(map(eq, words, words[1:]))
    if again:
        count["="] = again
    return count, len(words)


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    features: dict[str, int]
    weight: np.ndarray
    bias: np.ndarray

    def row(self, count: Counter, words: int) -> tuple[list[int], list[float]]:
        at = [(self.features[f], n) for f, n in count.items() if f in self.features]
        return [i for i, _ in at], [value(n, words) for _, n in at]

    def posteriors(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        """Of texts given as places and values of their features, one by one."""
        scores = np.array([self.bias + np.array(v) @ self.weight[i] if i else self.bias for i, v in rows])
        return softmax(scores.reshape(-1, len(self.domains)))

    def finder(self) -> Finder:
        return Finder(self.features)

    def judge(self, texts: pa.Array, known: Finder) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.judge_part(part, known) for part in slices(texts)] or [(np.zeros(0, np.int64), np.zeros((0, len(self.domains))))]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def judge_part(self, texts: pa.Array, known: Finder) -> tuple[np.ndarray, np.ndarray]:
        """(words, posterior) of every text; `known` finds the features of words that this model has.

        The distinct words of the batch are looked up once; features are counted for `TOGETHER` texts at a
        time and weighted by one product.
        """
        words, index, places = distinct_words(pc.utf8_trim_whitespace(texts))
        size, flat = known(words)
        begin = np.cumsum(size) - size
        blank = words.index("") if "" in words else -1  # an empty text is one empty word
        n_words = np.zeros(len(texts), np.int64)
        out = np.zeros((len(texts), len(self.domains)))
        width, again = len(self.features), self.features.get("=")
        for lo in range(0, len(texts), TOGETHER):
            hi = min(lo + TOGETHER, len(texts))
            at = index[places[lo] : places[hi]]
            owner = np.repeat(np.arange(hi - lo), np.diff(places[lo : hi + 1]))
            n_words[lo:hi] = np.bincount(owner[at != blank], minlength=hi - lo)
            found = flat[gathered(begin[at], size[at])] + np.repeat(owner, size[at]) * width
            if again is not None:
                same = (at[1:] == at[:-1]) & (owner[1:] == owner[:-1])
                found = np.concatenate([found, owner[1:][same] * width + again])
            count = np.bincount(found, minlength=(hi - lo) * width).reshape(hi - lo, width)
            some = np.maximum(1, n_words[lo:hi])[:, None]
            out[lo:hi] = np.where(count > 0, value(count, some), 0.0) @ self.weight + self.bias
        return n_words, softmax(out)


def value(n, words):
    """A feature's weight in a text: present at all, and how often in a hundred words."""
    return 0.5 + np.log1p(100.0 * n / words)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _choose(sample: DataFrame, domains: list[str], limit: int) -> list[str]:
    """Features whose occurrence differs most between the domains, by chi-squared; counted on the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(word_features, ROOM, entry=1500)
        total: Counter = Counter()
        for batch in batches:
            for text, domain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update((f, domain) for f in text_features(text, known)[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in total], pa.string()), pa.array([d for _, d in total], pa.string()), pa.array(list(total.values()), pa.int64())],
            names=["feature", "domain", "n"],
        )

    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    found = (
        sample.select("text", "domain").mapInArrow(count, "feature STRING, domain STRING, n BIGINT")
        .groupBy("feature")
        .agg(*[F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"d{i}") for i, d in enumerate(domains)])
    )
    seen = sum((F.col(f"d{i}") for i in range(len(domains))), F.lit(0))
    chi = F.lit(0.0)
    for i, d in enumerate(domains):
        size = float(sizes.get(d, 0)) or 1.0
        expected = seen * (size / n)
        chi = chi + F.pow(F.col(f"d{i}") - expected, F.lit(2.0)) / expected
    kept = found.where(seen >= 5).withColumn("chi", chi).orderBy(F.desc("chi"), "feature").limit(limit)
    return [r["feature"] for r in kept.select("feature").collect()]


def train(labelled: DataFrame, features: int = FEATURES, rounds: int = 300, l2: float = 1e-4) -> Classifier | None:
    """A softmax over chosen features from labelled rows (text, domain), a bounded sample; None without any.

    Domains without rows in the sample are unknown. Null texts have no features.
    """
    sample = cut_lineage(labelled.where("domain IS NOT NULL").select("text", "domain"), "labelled")
    domains = sorted(r["domain"] for r in sample.select("domain").distinct().collect())
    if not domains:
        return None
    names = {f: i for i, f in enumerate(_choose(sample, domains, features))}
    blank = Classifier(domains, names, np.zeros((len(names), len(domains))), np.zeros(len(domains)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(lambda w: [f for f in word_features(w) if f in names], ROOM, entry=300)
        for batch in batches:
            found = [blank.row(*text_features(t, known)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))],
                names=["domain", "at", "value"],
            )

    told = sample.mapInArrow(rows, "domain STRING, at ARRAY<INT>, value ARRAY<DOUBLE>").toArrow()
    x = np.zeros((told.num_rows, len(names)), np.float32)
    for i in range(told.num_rows):
        x[i, np.asarray(told["at"][i].values)] = np.asarray(told["value"][i].values)
    y = np.zeros((told.num_rows, len(domains)), np.float32)
    y[np.arange(told.num_rows), [domains.index(d) for d in told["domain"].to_pylist()]] = 1
    del told
    pa.default_memory_pool().release_unused()  # the driver goes on
    scale = np.maximum(1e-6, np.sqrt((x**2).mean(axis=0)))
    x /= scale
    weight, bias = np.zeros(blank.weight.shape, np.float32), np.log(y.mean(axis=0) + 1e-6)
    step = 4.0 / max(1.0, float((x**2).sum(axis=1).mean()))
    speed = np.zeros_like(weight)
    for _ in range(rounds):
        wrong = (softmax(x @ weight + bias) - y) / len(y)
        speed = 0.9 * speed - step * (x.T @ wrong + l2 * weight)
        weight += speed
        bias -= step * wrong.sum(axis=0)
    return Classifier(domains, names, (weight / scale[:, None]).astype(float), bias.astype(float))


def labelled_sample(docs: DataFrame, labels: DataFrame, domain: Column, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """(text, domain) of about `sample` labelled documents, drawn by a hash of the id before any text is read.

    A document that is told several domains is a row of each. Where an id stands in very many rows, four
    times `sample` rows are taken.
    """
    told = labels.select(F.col("doc_id"), domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL").distinct()
    n = told.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 30))
    drawn = told.where(draw <= F.lit(int(min(1.0, sample / max(1, n)) * (1 << 30))))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "domain").limit(4 * sample)


def posteriors(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The columns `keep` with n_tokens (words) and the posterior of each row, by the domains' order.

    Only the text goes to Python, and it goes there once.
    """

    kind = pa.struct([("n_tokens", pa.int64()), ("posterior", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<n_tokens:bigint,posterior:array<double>>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = model.finder()
        try:
            for texts in batches:
                n, p = model.judge(texts, known)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.StructArray.from_arrays([pa.array(n), rows], fields=list(kind))
        finally:
            pa.default_memory_pool().release_unused()

    told = cut_lineage(docs.select(*keep, judged(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_told")), "posteriors")
    return told.select(*keep, "_told.n_tokens", "_told.posterior")


def rates_of(p: np.ndarray, residuals: list[np.ndarray], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the given rounds, and the point the next residual is taken at (with momentum)."""
    step = 1 / (1 + ridge)
    rate = np.ones(len(p))
    ahead, t = rate, 1.0
    for e in residuals:
        new = np.maximum(0.0, ahead - step * (p @ e + ridge * (ahead - 1)))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = np.maximum(0.0, new + (before - 1) / t * (new - rate))
        rate = new
    return rate, ahead


def _each(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        yield batch, np.array(batch.column("posterior").flatten()).reshape(-1, width)


def fit(
    table: DataFrame, target: np.ndarray, share: np.ndarray, total: float, ridge: float = RIDGE, rounds: int = ROUNDS
) -> list[np.ndarray]:
    """Weighted residuals of the rounds, from which `rates_of` gives the fitted rates."""
    residuals: list[np.ndarray] = []
    width = len(target)
    while len(residuals) < rounds:
        so_far = list(residuals)

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(width)
            for batch, p in _each(batches, width):
                sums += (rates_of(p, so_far, ridge)[1] * batch.column("n_tokens").to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(sums)], names=["domain", "tokens"])

        found = table.select("n_tokens", "posterior").mapInArrow(expected, "domain BIGINT, tokens DOUBLE").groupBy("domain").agg(F.sum("tokens").alias("tokens"))
        now = np.zeros(width)
        for r in found.collect():  # one row a domain
            now[r["domain"]] = r["tokens"]
        residuals.append((now / max(1.0, total) - target) / np.maximum(share, LEAST_SHARE))
        if len(residuals) > 3 and np.abs(residuals[-1] - residuals[-2]).max() < TOLERANCE and np.abs(residuals[-2] - residuals[-3]).max() < TOLERANCE:
            return residuals
    warnings.warn(f"rates still move after {rounds} rounds", stacklevel=2)
    return residuals


def mixed(
    docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float] | None, ridge: float = RIDGE, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE
) -> DataFrame:
    """The columns `keep` of every row with n_tokens, domain, posterior and rate.

    `domain` names the domain of a row of `labels` (doc_id, ...). `targets` are the shares of the domains in
    the mixture, relative to the tokens of all rows; domains it does not name share what these leave, in
    proportion to their expected tokens. The ridge leaves about a hundredth of the way to a target.
    `domain` of the result is the most probable one. A null or empty text
    has no tokens and the posterior of a text without features; it does not count towards the targets.
    Without labels every rate is one and the domain null. Repeated rows and null ids are kept, each with its
    own rate; an empty table gives an empty result; columns other than text and `keep` are not read.
    """
    model = train(labelled_sample(docs, labels, domain, sample))
    if model is None:
        tokens = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+"), lambda w: w != ""))
        return docs.select(
            *keep, tokens.cast("bigint").alias("n_tokens"), F.lit(None).cast("string").alias("domain"),
            F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"),
        )
    table = posteriors(docs, model, list(keep))
    names = model.domains
    sums = table.agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)),
        *[F.coalesce(F.sum(F.col("n_tokens") * F.col("posterior")[i]), F.lit(0.0)) for i in range(len(names))],
    ).first()
    total, natural = float(sums[0]), np.array([float(x) for x in sums[1:]])
    named = {d: w for d, w in (targets or {}).items() if d in names}
    rest = natural.sum() - sum(n for d, n in zip(names, natural) if d in named)
    left = max(0.0, 1.0 - sum(named.values())) if named else rest / max(1.0, total)
    wanted = np.array([named.get(d, left * now / max(1e-300, rest)) for d, now in zip(names, natural)])
    residuals = fit(table, wanted, natural / max(1.0, total), total, ridge) if total else []
    width = len(names)

    @F.pandas_udf("struct<domain:string,rate:double>")
    def rated(p: pd.Series) -> pd.DataFrame:
        rows = np.array(p.tolist()).reshape(-1, width)
        return pd.DataFrame({"domain": [names[i] for i in rows.argmax(axis=1)], "rate": rates_of(rows, residuals, ridge)[0]})

    # as one that may differ from call to call it is called once a row; else a filter on the rate takes a call of its own,
    # and with it a second Python worker for each task, which live on
    found = table.withColumn("_rated", rated.asNondeterministic()("posterior"))
    return found.select(*keep, "n_tokens", "_rated.domain", "posterior", "_rated.rate")


def copies(rate: Column, key: Column) -> Column:
    """Whole copies with the rate as their mean, decided by a hash."""
    chance = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + chance).cast("int")


def quality_domain() -> Column:
    """Domains of a labelled row: toxic, or else high or low quality; null if neither is told."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The rows of documents, each as often as its rate asks for; rows keep all their columns.

    Rates become copies by a hash of the id, so a rate of one or more keeps the row. Odd rows are those of
    `mixed`: a row without tokens has the rate of a text without features, rows alike have one rate.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    found = mixed(rows, labels, quality_domain(), targets, keep=("doc_id", "_row"))
    times = copies(F.col("rate"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    kept = found.select("_row", times.alias("_n")).where("_n > 0")
    return kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
