"""Whitening on the leading principal components, found by a matrix-free Jacobi-Davidson iteration.

The covariance matrix is never formed. A pass over the fitted vectors gives its product with a few vectors;
all else is small arithmetic on the driver: the Rayleigh-Ritz step in the search space, MINRES for the
projected correction equations (one pass a step, all wanted pairs together), and the locking of pairs whose
residual has reached double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.blocks import finite
from statuta.session import cut_lineage

COMPONENTS = 4
SCALE = 256
#: Largest size of an integer component: doubles hold integers exactly up to here.
LARGEST = 1 << 53
#: A pair is locked when its residual is this small against the largest eigenvalue.
RESIDUAL = 512 * np.finfo(float).eps
#: Pairs that are improved beside the wanted ones, so that close eigenvalues behind them do no harm.
GUARDS = 4
SPACE = 40
INNER = 3
ROUNDS = 500
#: Partial sums that may reach the driver in one pass, a row of one block of products each.
GATHERED = 256

Product = Callable[[np.ndarray], np.ndarray]


def minres(product: Product, right: np.ndarray, steps: int, reduction: float) -> np.ndarray:
    """Solutions of `product`(x) = right, column by column, after at most `steps` products of all columns.

    The operator is symmetric and may be indefinite. A column stands still when its residual has fallen by
    `reduction` or its Krylov space is used up.
    """
    x = np.zeros_like(right)
    before, now = np.zeros_like(right), right.copy()
    turned, last = np.zeros_like(right), np.zeros_like(right)
    beta = np.linalg.norm(now, axis=0)
    start, eta = beta.copy(), beta.copy()
    c0, c1 = np.ones_like(beta), np.ones_like(beta)
    s0, s1 = np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        open_ = (np.abs(eta) > reduction * start) & (beta > 1e-14 * start)
        if not open_.any():
            break
        now = np.where(open_, now / np.where(open_, beta, 1.0), 0.0)
        image = product(now)
        alpha = np.einsum("ij,ij->j", now, image)
        after = image - alpha * now - beta * before
        beta_after = np.linalg.norm(after, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        rho1 = np.hypot(delta, beta_after)
        rho2, rho3 = s1 * alpha + c0 * c1 * beta, s0 * beta
        safe = np.where(rho1 > 0, rho1, 1.0)
        c0, c1, s0, s1 = c1, delta / safe, s1, beta_after / safe
        turned, last = last, (now - rho3 * turned - rho2 * last) / safe
        x += np.where(open_, c1 * eta, 0.0) * last
        eta = np.where(open_, -s1 * eta, eta)
        before, now, beta = now, after, np.where(open_, beta_after, 0.0)
    return x


def _orthonormal(new: np.ndarray, *held: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the part of `new` outside the spaces held; columns that lie inside are gone."""
    kept: list[np.ndarray] = []
    base = np.concatenate(held, axis=1)
    for column in new.T:
        length = np.linalg.norm(column)
        if not length:
            continue
        column = column / length
        for _ in range(3):
            column = column - base @ (base.T @ column)
            for k in kept:
                column = column - k * (k @ column)
            length = np.linalg.norm(column)
            if length < 1e-10:
                break
            column = column / length
        else:
            kept.append(column)
    return np.stack(kept, axis=1) if kept else np.zeros((len(new), 0))


def jacobi_davidson(
    product: Product, size: int, wanted: int, space: int = SPACE, inner: int = INNER, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric operator.

    `product` maps a (size, b) block of vectors to their images. Ends when every wanted pair is locked, that
    is, its residual is at most `RESIDUAL` of the largest eigenvalue; raises after `rounds` without that.
    A space that covers all dimensions gives exact pairs at once.
    """
    wanted = min(wanted, size)
    space = max(space, 4 * (wanted + GUARDS))
    draw = np.random.default_rng(11)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    basis = _orthonormal(draw.normal(size=(size, min(size, 2 * (wanted + GUARDS)))), locked)
    images = product(basis)
    for _ in range(rounds):
        small = basis.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        targets = min(wanted - len(values) + GUARDS, len(theta))
        basis, images = basis @ turn, images @ turn
        ritz, residual = basis[:, :targets], images[:, :targets] - basis[:, :targets] * theta[:targets]
        size_of = np.linalg.norm(residual, axis=0)
        top = max(np.abs(values).max(initial=0), np.abs(theta).max(initial=0))
        whole = len(values) + len(theta) == size
        done = 0  # pairs are locked from the largest on
        while done < min(targets, wanted - len(values)) and (whole or size_of[done] <= RESIDUAL * top):
            done += 1
        if done:
            locked, values = np.concatenate([locked, basis[:, :done]], axis=1), np.append(values, theta[:done])
            basis, images, theta = basis[:, done:], images[:, done:], theta[done:]
        if len(values) >= wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        ritz, residual, shift = ritz[:, done:], residual[:, done:], theta[: targets - done]
        out = np.concatenate([locked, ritz], axis=1)

        def corrected(block: np.ndarray) -> np.ndarray:
            block = block - out @ (out.T @ block)
            image = product(block) - block * shift
            return image - out @ (out.T @ image)

        right = out @ (out.T @ residual) - residual
        new = _orthonormal(minres(corrected, right, inner, 0.05), locked, basis)
        if not new.shape[1]:
            new = _orthonormal(draw.normal(size=(size, 1)), locked, basis)
        if basis.shape[1] + new.shape[1] > space:
            keep = space // 2
            basis, images = basis[:, :keep], images[:, :keep]
        basis, images = np.concatenate([basis, new], axis=1), np.concatenate([images, product(new)], axis=1)
    raise RuntimeError(f"{len(values)} of {wanted} components found in {rounds} rounds")


def integers(vecs: np.ndarray, scale: int, largest: int = LARGEST) -> np.ndarray:
    """floor(scale * x) of every component as int64, held at -largest and largest."""
    return np.clip(np.floor(scale * vecs.astype(np.float64)), -largest, largest).astype(np.int64)


def _code(x: np.ndarray) -> list[bytes]:
    """One byte string for each integer vector: two bytes a component where they do, else eight."""
    narrow = (np.abs(x) < 1 << 15).all(axis=1)
    short, long = x.astype("<i2"), x.astype("<i8")
    return [(short if n else long)[i].tobytes() for i, n in enumerate(narrow.tolist())]


def _decode(column: pa.Array, size: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), size), np.int64)
    narrow = np.array([len(r) == 2 * size for r in raw], bool)
    for kind, at in (("<i2", np.nonzero(narrow)[0]), ("<i8", np.nonzero(~narrow)[0])):
        out[at] = np.frombuffer(b"".join([raw[i] for i in at]), kind).reshape(len(at), size)
    return out


def coded(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """((id, x BINARY) of the rows that take part, number of components).

    Only vectors of one length have a covariance: the length of the most rows, of equals the larger.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(finite(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1).flatten().to_numpy().reshape(-1, size), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_code(x), pa.binary())], names=["id", "x"])

    return rows.where(F.size("vec") == size).mapInArrow(run, "id BIGINT, x BINARY"), size


def _one_row(sums: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = None
    for found in sums:
        total = found if total is None else total + found
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["v"])


class Fit:
    """The distinct integer vectors, written once, and sums over all of them."""

    def __init__(self, rows: DataFrame, size: int):
        self.table, self.size = cut_lineage(rows.select("x").distinct(), "fit"), size
        self.parts = self.table.rdd.getNumPartitions()
        self.n, self.sums = self.table.count(), self._exact_sums()
        self.mean = np.array([s / self.n if self.n else 0.0 for s in self.sums])

    def _exact_sums(self) -> list[int]:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * size
            for batch in batches:
                x = _decode(batch.column(0), size)
                safe = len(x) * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62
                total = [a + int(b) for a, b in zip(total, (x if safe else x.astype(object)).sum(axis=0))]
            yield pa.RecordBatch.from_arrays([pa.array([list(map(str, total))], pa.list_(pa.string()))], names=["s"])

        parts = self.table.mapInArrow(run, "s ARRAY<STRING>").select(F.posexplode("s").alias("j", "s"))
        found = parts.groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        return [int(s) for _, s in sorted(map(tuple, found))] or [0] * size

    def summed(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of `part` over all vectors; it gets blocks of centred vectors and gives a flat array.

        A task sends the sum of its blocks as one row. While there are more rows than `GATHERED`, a further
        step adds them up in groups; no more than that reach the driver.
        """
        size, mean = self.size, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _one_row(part(_decode(batch.column(0), size) - mean) for batch in batches)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _one_row(np.frombuffer(raw) for batch in batches for raw in batch.column(0).to_pylist())

        found, rows = self.table.mapInArrow(run, "v BINARY"), self.parts
        while rows > GATHERED:
            rows = -(-rows // GATHERED)
            found = found.repartition(rows).mapInArrow(add, "v BINARY")
        return sum(np.frombuffer(r["v"]) for r in found.collect())

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance matrix times a block of vectors."""
        return self.summed(lambda x: (x.T @ (x @ block)).ravel()).reshape(block.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0]) / self.n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - sum)^2, exactly; None where it leaves 64 bits."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    if len(sums) * most * most < 1 << 62:
        return ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


OUT = "component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    space: int = SPACE,
    inner: int = INNER,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every row and leading component.

    Components of a vector become floor(scale * c). The covariance is that of the distinct integer vectors,
    so copies, however many, weigh once; they are combined before they are shuffled. Rows whose vector is
    null, empty, or holds null or non-finite entries are left out, likewise those of another length than
    most rows have. Rows without an id, repeated rows and repeated ids give rows like any other. Integers are
    held at 2^53 in size; a deviation beyond 64 bits is null. Components without variance do not exist: a
    table of one distinct vector, like an empty one, gives no rows. Eigenvectors of equal eigenvalues are any
    basis of their space; signs are the iteration's, the same for all rows. Other columns are not read.

    Each pass reads the written table of distinct vectors; a task sends one row, its part of the product.
    """
    spark = vectors.sparkSession
    rows, size = coded(vectors, scale, id_col, vec_col)
    schema = f"`{id_col}` BIGINT, {OUT}"
    fit = Fit(rows, size)
    if not fit.n:
        return spark.createDataFrame([], schema)
    values, basis = jacobi_davidson(fit.product, size, components, space, inner)
    real = values > RESIDUAL * values.max(initial=0.0)
    if not real.any():
        return spark.createDataFrame([], schema)
    basis, explained = basis[:, real] / np.sqrt(values[real]), values[real] / fit.trace()
    k = basis.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ basis
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = fit.summed(moments) / fit.n
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    error = float(np.abs(covariance - np.eye(k)).max())
    n, sums, mean = fit.n, fit.sums, fit.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _decode(batch.column(1), size)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(((x - mean) @ basis).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
