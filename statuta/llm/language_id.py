"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word is the hashed character n-grams of `<word>`; a text is the mean of the embeddings of all n-grams of all
its words. Embeddings and softmax are trained together by stochastic gradient descent in numpy. Probabilities
are calibrated by a temperature, and the rejection threshold is read off the calibration texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.words import Memo, given_back

BUCKETS = 1 << 14
WIDTH = 16
GRAMS = (2, 3, 4)
#: Bound of the training sample, in documents; also the most that reach the driver.
SAMPLE = 2400
#: Bytes of the store of words while the sample is read.
ROOM = 48 << 20
UNKNOWN = "und"
#: Step of an embedding as a multiple of the softmax's: an n-gram holds a small share of a text.
EMBEDDING_RATE = 60.0


def grams(word: str) -> list[int]:
    marked = f"<{word}>".encode()
    return [
        zlib.crc32(marked[i : i + n]) % BUCKETS for n in GRAMS for i in range(max(1, len(marked) - n + 1))
    ]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: what one n-gram adds to the scores, embeddings times softmax
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        return softmax((mean + self.bias) / self.temperature)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@given_back
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text as its n-gram buckets and their shares."""
    known = Memo(lambda word: np.array(grams(word), np.int16).tobytes(), ROOM)  # a list takes several times the bytes
    for batch in batches:
        places, shares = [], []
        for text in batch.column(2).to_pylist():
            found = b"".join(map(known.__getitem__, (text or "").lower().split()))
            at, n = np.unique(np.frombuffer(found, np.int16), return_counts=True)
            places.append(at)
            shares.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int16())), pa.array(shares, pa.list_(pa.float32()))],
            names=["id", "lang", "places", "shares"],
        )


def _dense(places: list, shares: list) -> np.ndarray:
    x = np.zeros((len(places), BUCKETS), np.float32)
    for row, (at, share) in enumerate(zip(places, shares)):
        x[row, at] = share
    return x


def _descend(places, shares, labels, n_languages: int, rounds: int, rate: float, seed: int):
    random = np.random.default_rng(seed)
    embed = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, n_languages), np.float32), np.zeros(n_languages, np.float32)
    for turn in range(rounds):
        order = random.permutation(len(labels))
        step = rate * (1 - turn / rounds)
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            x = _dense([places[i] for i in rows], [shares[i] for i in rows])
            hidden = x @ embed
            wrong = softmax(hidden @ weight + bias)
            wrong[np.arange(len(rows)), labels[rows]] -= 1
            wrong /= len(rows)
            back = wrong @ weight.T
            weight -= step * (hidden.T @ wrong)
            bias -= step * 0.1 * wrong.sum(axis=0)
            used = np.nonzero(x.any(axis=0))[0]  # buckets outside the batch have no gradient
            embed[used] -= step * EMBEDDING_RATE * (x[:, used].T @ back)
    return embed @ weight, bias


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
    rounds: int = 12,
    rate: float = 2.0,
    lost: float = 0.001,
    seed: int = 7,
) -> Model | None:
    """A model from at most about `sample` labelled rows (chosen by a hash of id and text); None without any.

    Rows alike in id and text are drawn together; however many they are, four times `sample` rows are taken.

    A fifth of the sample is held back: its likelihood sets the temperature, and the threshold is the score
    below which at most `lost` of its rightly named texts lie, never above one half.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    n = rows.select("lang").count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.lit(seed)), F.lit(1 << 30))
    share = min(1.0, sample / n)
    drawn = rows.where(draw < F.lit(int(share * (1 << 30)))).limit(4 * sample) if share < 1 else rows
    found = drawn.select(F.col("id").cast("string"), "lang", "text").mapInArrow(
        _features, "id STRING, lang STRING, places ARRAY<SMALLINT>, shares ARRAY<FLOAT>"
    )
    told = found.toArrow()
    if not told.num_rows:
        return None
    order = pc.sort_indices(told.select(["id", "lang"]), sort_keys=[("id", "ascending"), ("lang", "ascending")])
    langs = told["lang"].take(order).to_pylist()
    names = sorted(set(langs))
    labels = np.array([names.index(x) for x in langs])
    places = [np.asarray(told["places"][i].values) for i in order.to_numpy()]  # views, no copies
    shares = [np.asarray(told["shares"][i].values) for i in order.to_numpy()]
    held = np.arange(len(labels)) % 5 == 4
    if held.sum() < 10:
        held[:] = False
    fit = np.nonzero(~held)[0]
    table, bias = _descend(
        [places[i] for i in fit], [shares[i] for i in fit], labels[fit], len(names), rounds, rate, seed
    )
    check = np.nonzero(held)[0] if held.any() else fit
    scores = np.stack([shares[i] @ table[places[i]] + bias for i in check])
    heat = np.geomspace(0.05, 20, 121)
    # smoothed targets: a sample of n right answers can't vouch for more than about 1 - 1/n
    smooth = 1 / (len(check) + 2)
    target = np.full((len(check), len(names)), smooth / max(1, len(names) - 1))
    target[np.arange(len(check)), labels[check]] = 1 - smooth
    loss = [-(target * np.log(softmax(scores / t) + 1e-300)).sum(axis=1).mean() for t in heat]
    temperature = float(heat[int(np.argmin(loss))])
    p = softmax(scores / temperature)
    sure = p.max(axis=1)[p.argmax(axis=1) == labels[check]]
    threshold = float(min(0.5, np.quantile(sure, lost))) if len(sure) else 0.5
    del told, found, places, shares
    pa.default_memory_pool().release_unused()  # the driver goes on
    return Model(names, table.astype(np.float64), bias.astype(np.float64), temperature, threshold)


def predict(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang_pred, score, rejected) for every row, from the whole text alone.

    `und` with score 0 for texts that are null or have no letter, and for every text if there is no model.
    `rejected` is true for those and where the calibrated probability is below the model's threshold. Equal
    probabilities go to the language first in the alphabet. Repeated rows and null ids are kept; an empty
    table gives an empty result; other columns are not read.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if model is None else Scorer(model)
        for batch in batches:
            langs, scores, out = [], [], []
            for text in batch.column(1).to_pylist():
                if scorer is None or not text or not has_letter(text):
                    lang, score, gone = UNKNOWN, 0.0, True
                else:
                    p = scorer.probabilities(text)
                    best = int(p.argmax())
                    lang, score = model.languages[best], float(p[best])
                    gone = score < model.threshold
                langs.append(lang)
                scores.append(score)
                out.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())],
                names=[id_col, "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(named, f"`{id_col}` {kind}, lang_pred STRING, score DOUBLE, rejected BOOLEAN")


class Scorer:
    """Probabilities of whole texts; what a word adds is kept as a row of a matrix."""

    KEEP = 300_000

    def __init__(self, model: Model):
        self.model = model
        self.start()

    def start(self) -> None:
        self.places: dict[str, int] = {}
        self.rows = np.zeros((4096, len(self.model.languages) + 1))

    def place(self, word: str) -> int:
        at = self.places[word] = len(self.places)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        found = grams(word)
        self.rows[at, :-1] = self.model.table[found].sum(axis=0)
        self.rows[at, -1] = len(found)
        return at

    def probabilities(self, text: str) -> np.ndarray:
        if len(self.places) > self.KEEP:
            self.start()
        words = text.lower().split()
        places, get = [], self.places.get
        for word in words:
            at = get(word)
            places.append(self.place(word) if at is None else at)
        total = self.rows[places].sum(axis=0)
        return self.model.probabilities(total[:-1] / total[-1])


def held_out(id_col: str = "doc_id") -> Column:
    """Documents kept from training: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Train on the rows that are not held out, predict all: (id, held_out, lang_pred, score, rejected)."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **options)
    return predict(docs, model, id_col, text_col).select(
        id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is named with enough certainty, with all their columns."""
    model = train(docs.where(~held_out()))
    return keep(docs, model)


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows as they are, without those that `predict` rejects; no join and no shuffle."""
    @given_back
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if model is None else Scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            mask = [
                scorer is not None and bool(t) and has_letter(t) and float(scorer.probabilities(t).max()) >= model.threshold
                for t in texts
            ]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
