"""Linear one-vs-rest classifiers, any number of settings fitted together (inventory M2, M13).

The training rows are scaled and packed once into blocks of ``BLOCK_ROWS`` rows, a matrix per table row, dealt out
evenly whatever their order and copies. Every pass over the blocks advances all settings and classes at once: a task keeps
one sum of (settings x classes) x (features + 1) numbers, so the passes depend neither on the number of settings nor on
the classes. Only such sums reach the driver, never rows.

``sgd``: a pass is an epoch. Each block takes mini-batch steps from the common coefficients, with hinge or log loss, an L2
penalty and a falling rate; the blocks' results are averaged by their rows (parameter mixing).
``gradient``: a pass is one accelerated proximal step on the full log loss with an elastic-net penalty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.session import materialize

BLOCK_ROWS = 4096
_BLOCKS = "n long, x binary, y binary"


@dataclass(frozen=True)
class Setting:
    """``loss``: 'hinge' or 'log'; ``alpha``: strength of the penalty; ``l1``: its L1 share (full gradient only);
    ``rate`` and ``power``: step t of SGD has the rate rate / (1 + rate * alpha * t) ** power."""
    loss: str = "hinge"
    alpha: float = 1e-4
    l1: float = 0.0
    rate: float = 0.1
    power: float = 1.0


@dataclass
class Fit:
    """Coefficients (classes x features + 1, the intercept last) on scaled features, one array per setting."""
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    coefficients: list[np.ndarray]


def scaling(train: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each feature without nulls and NaN; 1 for one that does not vary."""
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    row = train.agg(*[F.avg(c) for c in clean], *[F.stddev_pop(c) for c in clean]).first()
    mean = np.array([x or 0.0 for x in row[:len(features)]], float)
    std = np.array([x or 0.0 for x in row[len(features):]], float)
    return mean, np.where(std > 0, std, 1.0)


def _matrix(b: pa.RecordBatch, features: list[str], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled features of a batch and a column of ones; a missing value is the mean."""
    x = np.ones((b.num_rows, len(features) + 1))
    for j, c in enumerate(features):
        x[:, j] = (b.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) - mean[j]) / scale[j]
    return np.nan_to_num(x, copy=False)


def pack(train: DataFrame, features: list[str], label: str, mean: np.ndarray, scale: np.ndarray,
         rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (n, x, y) of the rows that have a label, written once."""
    data = train.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features])
    parts = max(1, -(-data.count() // (16 * rows)))

    def run(batches):
        x, y = np.zeros((0, len(features) + 1)), np.zeros(0, np.int32)
        done = False
        batches = iter(batches)
        while not done:
            b = next(batches, None)
            done = b is None
            if b is not None:
                x = np.concatenate([x, _matrix(b, features, mean, scale)])
                y = np.concatenate([y, b.column("_y").to_numpy().astype(np.int32)])
            while len(y) >= rows or (done and len(y)):
                cut = min(rows, len(y))
                # a block's own order: neither storage order nor its labels decide the steps
                order = np.random.default_rng(cut).permutation(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cut]), pa.array([x[:cut][order].tobytes()]), pa.array([y[:cut][order].tobytes()])],
                    ["n", "x", "y"])
                x, y = x[cut:], y[cut:]

    return materialize(data.repartition(parts).mapInArrow(run, _BLOCKS), "linear-blocks")


def unpack(b: pa.RecordBatch, width: int):
    """(x, y) of each block of a batch."""
    for i in range(b.num_rows):
        y = np.frombuffer(b.column(2)[i].as_py(), np.int32)
        yield np.frombuffer(b.column(1)[i].as_py()).reshape(len(y), width), y


def block_epoch(x: np.ndarray, y: np.ndarray, w: np.ndarray, settings: list[Setting], classes: int, batch: int,
                step: int) -> np.ndarray:
    """Coefficients (settings * classes x width) after one epoch over a block, from ``w``, at step number ``step``."""
    hinge = np.repeat([s.loss == "hinge" for s in settings], classes)
    alpha, rate, power = (np.repeat([getattr(s, k) for s in settings], classes) for k in ("alpha", "rate", "power"))
    w = w.copy()
    target = np.tile(np.arange(classes), len(settings))
    for i, lo in enumerate(range(0, len(y), batch)):
        xb = x[lo:lo + batch]
        sign = np.where(y[lo:lo + batch, None] == target, 1.0, -1.0)
        margin = sign * (xb @ w.T)
        push = np.where(hinge, margin < 1, 1 / (1 + np.exp(np.clip(margin, -500, 500))))
        gradient = -(sign * push).T @ xb / len(xb)
        gradient[:, :-1] += alpha[:, None] * w[:, :-1]
        w -= (rate / (1 + rate * alpha * (step + i)) ** power)[:, None] * gradient
    return w


def _sum_over(blocks: DataFrame, width: int, fn) -> np.ndarray:
    """Sum over all blocks of ``fn(x, y)``, a flat array: one row per task, added up by position."""
    def run(batches):
        total = None
        for b in batches:
            for x, y in unpack(b, width):
                part = fn(x, y)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])
    parts = blocks.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("at", "v"))
    rows = parts.groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # one row per coefficient
    out = np.zeros(rows.num_rows)
    out[rows["at"].to_numpy()] = rows["v"].to_numpy()
    return out


def fit_sgd(train: DataFrame, features: list[str], label: str, settings: list[Setting], classes: int = 4,
            epochs: int = 10, batch: int = 64, rows: int = BLOCK_ROWS) -> Fit:
    """Stochastic gradient descent for every setting, in ``epochs`` passes. Without labelled rows all are zero."""
    mean, scale = scaling(train, features)
    blocks = pack(train, features, label, mean, scale, rows)
    width, m = len(features) + 1, len(settings) * classes
    w = np.zeros((m, width))
    for epoch in range(epochs):
        start, step = w, epoch * (rows // batch)

        def one(x, y, start=start, step=step):
            return np.append(block_epoch(x, y, start, settings, classes, batch, step).ravel() * len(y), len(y))
        total = _sum_over(blocks, width, one)
        if not len(total):
            break
        w = (total[:-1] / total[-1]).reshape(m, width)
    return Fit(list(features), mean, scale, list(w.reshape(len(settings), classes, width)))


def fit_gradient(train: DataFrame, features: list[str], label: str, settings: list[Setting], classes: int = 4,
                 passes: int = 40, rows: int = BLOCK_ROWS) -> Fit:
    """Log loss with alpha * (l1 * |w| + (1 - l1) / 2 * |w|^2) for every setting, in ``passes`` passes and one more."""
    mean, scale = scaling(train, features)
    blocks = pack(train, features, label, mean, scale, rows)
    width, m = len(features) + 1, len(settings) * classes
    alpha, share = (np.repeat([getattr(s, k) for s in settings], classes)[:, None] for k in ("alpha", "l1"))
    target = np.tile(np.arange(classes), len(settings))
    gram = _sum_over(blocks, width, lambda x, y: np.append((x.T @ x).ravel(), len(y)))
    w = np.zeros((m, width))
    if not len(gram):
        return Fit(list(features), mean, scale, list(w.reshape(len(settings), classes, width)))
    n = gram[-1]
    # the log loss bends no more than a quarter of the greatest eigenvalue
    pace = 1 / (0.25 * np.linalg.eigvalsh(gram[:-1].reshape(width, width) / n)[-1] + alpha * (1 - share))
    penalised = np.append(np.ones(width - 1), 0.0)
    ahead, t = w, 1.0
    for _ in range(passes):
        def one(x, y, at=ahead):
            sign = np.where(y[:, None] == target, 1.0, -1.0)
            margin = sign * (x @ at.T)
            return (-(sign / (1 + np.exp(np.clip(margin, -500, 500)))).T @ x).ravel()
        gradient = _sum_over(blocks, width, one).reshape(m, width) / n + alpha * (1 - share) * ahead * penalised
        new = ahead - pace * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - pace * alpha * share * penalised, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return Fit(list(features), mean, scale, list(w.reshape(len(settings), classes, width)))


def predict(fit: Fit, df: DataFrame, label: str, keep=()) -> DataFrame:
    """``keep`` columns, label, and per setting the class of the greatest margin and, for class 1, its margin, from
    one scan."""
    stacked = np.concatenate(fit.coefficients)
    k, classes = len(fit.coefficients), len(fit.coefficients[0])
    given = df.select(*keep, F.col(label).cast("int").alias("label"),
                      *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(fit.features)])
    names = [f"_x{i}" for i in range(len(fit.features))]
    fixed = given.columns[:len(given.columns) - len(names)]

    def run(batches):
        for b in batches:
            margins = (_matrix(b, names, fit.mean, fit.scale) @ stacked.T).reshape(b.num_rows, k, classes)
            off = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in fixed),
                 pa.ListArray.from_arrays(off, pa.array(margins.argmax(2).astype(np.int32).ravel())),
                 pa.ListArray.from_arrays(off, pa.array(margins[:, :, min(1, classes - 1)].ravel()))],
                [*fixed, "predictions", "margins"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:len(fixed)])
    return given.mapInArrow(run, f"{schema}, predictions array<int>, margins array<double>")


def losses(fit: Fit, df: DataFrame, label: str, classes: int) -> list[float]:
    """Macro-F1 loss of every setting on ``df``, from one scan and one grouping."""
    from wardspark.operators.score import confusion, macro_f1_loss
    long = predict(fit, df, label).select("label", F.posexplode("predictions").alias("setting", "prediction"))
    out = {r["setting"]: r["loss"] for r in macro_f1_loss(confusion(long, classes, by=("setting",)), by=("setting",)).collect()}
    return [float(out.get(i, 0.0)) for i in range(len(fit.coefficients))]
