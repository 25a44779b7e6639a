"""Light models on features and embeddings (H1-H8)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.functions import dsp
from corpuslens.functions.keys import md5_key
from corpuslens.functions.signal import sigmoid
from corpuslens.operators import metrics, rules, sampling
from corpuslens.operators.order import average_ranks, hash_positions
from corpuslens.operators.rules import union_all
from corpuslens.session import freeze

# The six technical features, in order.
TECHNICAL_FEATURES = ["source_duration_seconds", "source_rms", "source_peak", "source_silence_ratio",
                      "source_sample_rate", "source_channels"]


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column: one aggregated row; a constant column scales by one."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scaled(df: DataFrame, scale: Mapping[str, tuple[float, float]], out: str = "features",
           bias: bool = False) -> DataFrame:
    cells = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()]
    if bias:
        cells.append(F.lit(1.0))
    return df.withColumn(out, array_to_vector(F.array(*cells)))


def technical_baseline(df: DataFrame, features: Sequence[str] = TECHNICAL_FEATURES, *,
                       check: bool = True, max_iter: int = 1000) -> dict[str, DataFrame]:
    """Train-to-dev logistic diagnostic for shortcuts (H1).

    The intercept is penalised like a weight, by a constant feature instead of a free intercept,
    and the penalty is one over the number of training rows (C = 1).
    """
    if check:
        rules.assert_clean(rules.union_all([rules.partition_gate(df), rules.non_finite(df, "utt_id", features)]))
    rows = df.select("utt_id", "split", (F.col("label") == "generated").cast("double").alias("truth"),
                     *features)
    train, dev = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "dev")
    scale = scaling(train, features)
    n = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol="truth", fitIntercept=False,
                            standardization=False, regParam=1.0 / n, maxIter=max_iter, tol=1e-9)
    model = lr.fit(scaled(train, scale, bias=True))
    scored = model.transform(scaled(dev, scale, bias=True)).select(
        "utt_id", F.col("truth").cast("int").alias("truth"),
        vector_to_array("probability")[1].alias("probability"), F.lit(0).alias("_all"))
    spark = df.sparkSession
    w = [float(v) for v in model.coefficients.toArray()]
    coefficients = spark.createDataFrame(
        [(f, v) for f, v in zip([*features, "intercept"], w)], "feature string, coefficient double")
    iterations = int(model.summary.totalIterations)
    fit = metrics.classification(scored, ["_all"], "probability", "truth").drop("_all").withColumn(
        "iterations", F.lit(iterations)).withColumn("converged", F.lit(iterations < max_iter))
    return {"scores": scored.drop("_all"), "coefficients": coefficients, "metrics": fit}


# --- heads on embeddings ----------------------------------------------------------------------

def linear_score(embedding: Column, weights: Sequence[float], bias: float) -> Column:
    """Probability from folded weights: a column expression, no model object."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    z = F.aggregate(F.zip_with(embedding, w, lambda e, v: e.cast("double") * v), F.lit(0.0), lambda a, b: a + b)
    return sigmoid(z + F.lit(bias))


@dataclass(frozen=True)
class Linear:
    """A logistic head as one weight vector and bias on the raw embedding, with the scale it was fitted on."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    spread: np.ndarray

    def score(self, df: DataFrame, embedding: str, out: str = "p_spoof") -> DataFrame:
        """Probability of the positive class."""
        return df.withColumn(out, linear_score(F.col(embedding), self.weights, self.bias))


def _of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if len(batch):
            yield np.stack(batch["x"].to_numpy()).astype(np.float64), batch["y"].to_numpy(np.float64), batch["fold"].to_numpy()


def _task_sums(batches: Iterator[pd.DataFrame], make: Callable[[np.ndarray, np.ndarray, np.ndarray], dict], read: Callable) -> Iterator[pd.DataFrame]:
    """One row for each key that ``make(x, y, folds)`` gives, summed over what a task reads."""
    held: dict = {}
    for x, y, folds in read(batches):
        for key, values in make(x, y, folds).items():
            held[key] = values if key not in held else held[key] + values
    for (model, part), values in held.items():
        yield pd.DataFrame({"model": [model], "part": [part], "values": [values.tobytes()]})


def _added(rows: DataFrame, make, read: Callable = _of_rows) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all rows: tasks add up their own, then the vectors of a key meet.

    What reaches the driver grows with folds and weights, never with rows.
    """
    schema = "model int, part int, values binary"
    partial = rows.mapInPandas(functools.partial(_task_sums, make=make, read=read), schema)
    total = partial.groupBy("model", "part").applyInPandas(
        lambda g: pd.DataFrame({"model": g["model"][:1], "part": g["part"][:1], "values": [np.sum([np.frombuffer(v) for v in g["values"]], axis=0).tobytes()]}), schema)
    return {(r["model"], r["part"]): np.frombuffer(r["values"]) for r in total.collect()}


def _moments(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> dict:
    """Count, sums and sums of squares of each fold's own rows."""
    return {(int(f), 0): np.concatenate([[m.sum()], x[m].sum(axis=0), (x[m] ** 2).sum(axis=0)])
            for f in np.unique(folds) for m in [folds == f]}


def _curvature(x: np.ndarray, y: np.ndarray, folds: np.ndarray, shift: np.ndarray, scale: np.ndarray,
               heads: Mapping[int, np.ndarray]) -> dict:
    """For each head, over the rows outside its fold: rows of the curvature matrix with the gradient, and the loss."""
    z = np.hstack([(x - shift) / scale, np.ones((len(x), 1))])
    out = {}
    for f, w in heads.items():
        rows, truth = z[folds != f], y[folds != f]
        s = rows @ w
        p = 1.0 / (1.0 + np.exp(-s))
        block = np.hstack([(rows * (p * (1 - p))[:, None]).T @ rows, (rows.T @ (p - truth))[:, None]])
        out |= {(f, i): block[i] for i in range(len(block))}
        out[f, -1] = np.array([np.logaddexp(0.0, s).sum() - s @ truth])
    return out


def fit_logistic(df: DataFrame, embedding: str, label: str, fold: str | None = None, k: int = 1, *,
                 tolerance: float = 1e-9, max_steps: int = 100) -> dict[int, Linear]:
    """Logistic heads of all folds at once, each fitted on the rows outside its fold (H2, H3).

    Standardised by the mean and deviation of its training rows, with half the squared weights as
    penalty (C = 1) and a free intercept, solved by Newton's method.  One pass over the rows serves a
    step of every head.  Without ``fold`` there is one head, number 0, on all rows.  Rows with a null
    embedding or label are left out.
    """
    own = F.lit(-1) if fold is None else F.col(fold).cast("int")
    rows = df.select(F.col(embedding).alias("x"), F.col(label).cast("double").alias("y"), own.alias("fold")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    sums = {f: v for (f, _), v in _added(rows, _moments).items()}
    if not sums:
        raise ValueError("no rows to fit a head on")
    whole = sum(sums.values())
    dim = (len(whole) - 1) // 2
    every = np.zeros_like(whole)

    def scale_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = v[1:dim + 1] / v[0]
        spread = np.sqrt(np.maximum(0.0, v[dim + 1:] / v[0] - mean ** 2))
        # Deviations below rounding are those of a constant, which scales by one.
        return mean, np.where(spread > 1e-9 * np.maximum(1.0, np.abs(mean)), spread, 1.0)

    shift, scale = scale_of(whole)
    own_scale = {f: scale_of(whole - sums.get(f, every)) for f in range(k)}
    # A head's own standardised weights, and the same as weights on rows standardised by the whole.
    weights = {f: np.zeros(dim + 1) for f in range(k)}

    def on_rows(f: int, w: np.ndarray) -> np.ndarray:
        mean, spread = own_scale[f]
        return np.append(w[:dim] * scale / spread, w[dim] + w[:dim] @ ((shift - mean) / spread))

    best, step, done = dict.fromkeys(range(k), np.inf), {f: np.zeros(dim + 1) for f in range(k)}, set()
    for _ in range(max_steps):
        heads = {f: on_rows(f, weights[f] + step[f]) for f in range(k) if f not in done}
        found = _added(rows, functools.partial(_curvature, shift=shift, scale=scale, heads=heads))
        for f in heads:
            w = weights[f] + step[f]
            loss = found[f, -1][0] + 0.5 * w[:dim] @ w[:dim]
            if loss > best[f] + 1e-12 * abs(best[f]):
                step[f] = step[f] / 2
                continue
            weights[f], best[f] = w, loss
            block = np.stack([found[f, i] for i in range(dim + 1)])
            mean, spread = own_scale[f]
            # From the rows' standardisation to the head's own: an affine map of each row.
            turn = np.diag(np.append(scale / spread, 1.0))
            turn[:dim, dim] = (shift - mean) / spread
            ridge = np.append(np.ones(dim), 0.0)
            gradient = turn @ block[:, -1] + ridge * w
            step[f] = -np.linalg.solve(turn @ block[:, :-1] @ turn.T + np.diag(ridge + 1e-12), gradient)
            if np.abs(step[f]).max() <= tolerance:
                done.add(f)
        if len(done) == k:
            break
    out = {}
    for f, w in weights.items():
        mean, spread = own_scale[f]
        raw = w[:dim] / spread
        out[f] = Linear(raw, float(w[dim] - raw @ mean), mean, spread)
    return out


#: Units of the hidden layer, rows that a pass works on at once, and earlier steps that shape the next one.
HIDDEN, BLOCK, MEMORY = 256, 512, 10


@dataclass(frozen=True)
class Layered:
    """A head with one hidden layer on standardised embeddings; the weights lie in the order of Spark ML."""

    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        dim = len(self.mean)
        hidden = (len(self.weights) - 2) // (dim + 3)
        inner, bias, outer, last = np.split(self.weights, np.cumsum([dim * hidden, hidden, 2 * hidden]))
        return inner.reshape(dim, hidden), bias, outer.reshape(hidden, 2), last

    def layers(self, x: np.ndarray, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Standardised rows, outputs of the hidden layer, and the two sums behind the probabilities."""
        inner, bias, outer, last = (v.astype(kind) for v in self.parts())
        z = ((x - self.mean) / self.spread).astype(kind)
        h = z @ -inner
        h -= bias
        with np.errstate(over="ignore"):
            np.exp(h, out=h)
        h += 1
        np.reciprocal(h, out=h)
        return z, h, (h @ outer).astype(np.float64) + last

    def slope(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sum over rows of the slope of the cross entropy at each weight, and of the cross entropy itself.

        The hidden layer of a block is worked out in single precision, as the vectors are stored; blocks
        are added up in double precision.
        """
        z, h, out = self.layers(x, np.float32)
        whole = np.logaddexp(out[:, 0], out[:, 1])
        truth = np.arange(2) == y[:, None]
        back = np.exp(out - whole[:, None]) - truth
        single = back.astype(np.float32)
        outer = h.T @ single
        inner = single @ self.parts()[2].T.astype(np.float32)
        inner *= h
        np.subtract(1, h, out=h)
        inner *= h
        return np.concatenate([(z.T @ inner).ravel(), inner.sum(axis=0), outer.ravel(), back.sum(axis=0), [whole.sum() - out[truth].sum()]])


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with ``x`` as bytes: a pass over them touches no single numbers."""
    for batch in batches:
        if len(batch):
            yield batch.assign(x=[v.tobytes() for v in np.stack(batch["x"].to_numpy()).astype(np.float64)])


def _of_packed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if len(batch):
            x = np.frombuffer(b"".join(batch["x"])).reshape(len(batch), -1)
            y, folds = batch["y"].to_numpy(np.float64), batch["fold"].to_numpy()
            for i in range(0, len(x), BLOCK):
                yield x[i:i + BLOCK], y[i:i + BLOCK], folds[i:i + BLOCK]


def _slopes(x: np.ndarray, y: np.ndarray, folds: np.ndarray, heads: Mapping[int, Layered]) -> dict:
    """For each head, over the rows outside its fold."""
    return {(f, 0): head.slope(x[folds != f], y[folds != f]) for f, head in heads.items()}


@dataclass(frozen=True)
class _Step:
    """A point on a line: how far along, the loss there, its rise along the line, and its slope."""

    t: float
    loss: float
    rise: float
    slope: np.ndarray


def _between(a: _Step, b: _Step) -> float:
    """The lowest point of the cubic through two steps, kept off both."""
    low, high = (a, b) if a.t < b.t else (b, a)
    width = high.t - low.t
    d1 = low.rise + high.rise + 3 * (low.loss - high.loss) / width
    d2 = np.sqrt(np.maximum(0.0, d1 * d1 - low.rise * high.rise))
    share = (high.rise + d2 - d1) / (high.rise - low.rise + 2 * d2 or 1.0)
    return float(high.t - width * np.clip(share, 0.1, 0.9))


def _along(w: np.ndarray, direction: np.ndarray, start: _Step, t: float):
    """A step with enough fall and a flat enough end (strong Wolfe conditions), None if twenty looks find none.

    Yields weights to look at and is sent the loss and its slope there.
    """
    def look(t: float):
        loss, slope = yield w + t * direction
        return _Step(t, loss, slope @ direction, slope)

    def too_high(c: _Step) -> bool:
        return c.loss > start.loss + 1e-4 * c.t * start.rise

    low, far = start, None
    for i in range(10):
        c = yield from look(t)
        if not np.isfinite(c.loss):
            t /= 2
            continue
        if too_high(c) or (c.loss >= low.loss and i > 0):
            far = c
            break
        if abs(c.rise) <= 0.9 * abs(start.rise):
            return c
        if c.rise >= 0:
            low, far = c, low
            break
        low, t = c, t * 1.5
    if far is None:
        return None
    for _ in range(10):
        c = yield from look(_between(low, far))
        if too_high(c) or c.loss >= low.loss:
            far = c
            continue
        if abs(c.rise) <= 0.9 * abs(start.rise):
            return c
        if c.rise * (far.t - low.t) >= 0:
            far = low
        low = c
    return None


def _downhill(slope: np.ndarray, past: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The direction of limited-memory BFGS from the last steps and what they changed in the slope."""
    q, shares = slope.copy(), []
    for s, g in reversed(past):
        shares.append((s @ q) / (s @ g))
        q -= shares[-1] * g
    if past:
        s, g = past[-1]
        q *= (s @ g) / (g @ g)
    for (s, g), share in zip(past, reversed(shares), strict=True):
        q += (share - (g @ q) / (s @ g)) * s
    return -q


def _descent(w: np.ndarray, max_steps: int, tolerance: float):
    """Limited-memory BFGS as a generator: yields weights, is sent their loss and slope, returns the last weights.

    The rules of steps and of their end are those of Spark ML's optimiser.
    """
    loss, slope = yield w
    first, losses, past, failed = loss, [loss], [], False
    for n in range(max_steps):
        if np.linalg.norm(slope) <= max(tolerance * abs(loss), 1e-8):
            break
        direction = _downhill(slope, past)
        start, step = _Step(0.0, loss, slope @ direction, slope), None
        if start.rise < 0:
            step = yield from _along(w, direction, start, 1.0 if n else 1.0 / np.linalg.norm(direction))
        if step is None:
            if failed:
                break
            past, failed = [], True
            continue
        failed = False
        past = [*past, (step.t * direction, step.slope - slope)][-MEMORY:]
        w, loss, slope = w + step.t * direction, step.loss, step.slope
        losses = [*losses, loss][-20:]
        if max(losses) - loss <= tolerance * abs(first):
            break
    return w


def _first_weights(spark: SparkSession, layers: Sequence[int], seed: int) -> np.ndarray:
    """Where Spark ML's own classifier starts: what it returns after no step."""
    rows = spark.range(2).select(F.col("id").cast("double").alias("y"), array_to_vector(F.array_repeat(F.lit(0.0), layers[0])).alias("x"))
    still = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=list(layers), seed=seed, maxIter=0)
    return still.fit(rows).weights.toArray()


def fit_layered(df: DataFrame, embedding: str, label: str, fold: str | None = None, k: int = 1, *, seed: int = 42,
                hidden: int = HIDDEN, max_steps: int = 400, tolerance: float = 1e-6) -> dict[int, Layered]:
    """Heads with one hidden layer of all folds at once, each fitted on the rows outside its fold (H2, H3).

    Loss, start, steps and their end are those of Spark ML's layered classifier, whose fit serves one head a
    pass; here one pass over the rows serves a look of every head.  Without ``fold`` there is one head, number
    0, on all rows.  Rows with a null embedding or label are left out.
    """
    spark = df.sparkSession
    own = F.lit(-1) if fold is None else F.col(fold).cast("int")
    rows = df.select(F.col(embedding).alias("x"), F.col(label).cast("double").alias("y"), own.alias("fold")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    # As many even parts as tasks run at once: every pass is as long as its longest task.
    rows = freeze(rows.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_packed, "x binary, y double, fold int"))
    sums = {f: v for (f, _), v in _added(rows, _moments, _of_packed).items()}
    if not sums:
        raise ValueError("no rows to fit a head on")
    whole = sum(sums.values())
    dim = (len(whole) - 1) // 2
    start = _first_weights(spark, [dim, hidden, 2], seed)
    count, scale, ways, asked, fitted = {}, {}, {}, {}, {}
    for f in range(k):
        v = whole - sums.get(f, np.zeros_like(whole))
        count[f], mean = v[0], v[1:dim + 1] / v[0]
        spread = np.sqrt(np.maximum(0.0, v[dim + 1:] / v[0] - mean ** 2))
        # Deviations below rounding are those of a constant, which scales by one.
        scale[f] = mean, np.where(spread > 1e-9 * np.maximum(1.0, np.abs(mean)), spread, 1.0)
        ways[f] = _descent(start, max_steps, tolerance)
        asked[f] = Layered(next(ways[f]), *scale[f])
    while asked:
        found = _added(rows, functools.partial(_slopes, heads=asked), _of_packed)
        for f in list(asked):
            v = found[f, 0] / count[f]
            try:
                asked[f] = Layered(ways[f].send((float(v[-1]), v[:-1])), *scale[f])
            except StopIteration as end:
                fitted[f] = Layered(end.value, *scale[f])
                del asked[f]
    return fitted


def layered_score(heads: Mapping[int, Layered], embedding: Column, fold: Column) -> Column:
    """Probability of the positive class by the head of the row's fold; null for a null embedding."""
    @dsp.kernel_udf("double")
    def score(x: pa.Array, folds: pa.Array) -> pa.Array:
        def kernel(m: np.ndarray, own: np.ndarray) -> np.ndarray:
            p = np.full(len(m), np.nan)
            for f in np.unique(own):
                out = heads[int(f)].layers(m[own == f])[2]
                p[own == f] = np.exp(out[:, 1] - np.logaddexp(out[:, 0], out[:, 1]))
            return p
        return dsp.in_order(dsp.by_length([x], kernel, folds.to_numpy(zero_copy_only=False)), len(x), 0)
    return score(embedding, fold)


def _fit_layered(df: DataFrame, embedding: str, label: str, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    heads = fit_layered(df, embedding, label, seed=seed)
    return lambda rows: rows.withColumn("p_spoof", layered_score(heads, F.col(embedding), F.lit(0)))


def _logistic_by_fold(df: DataFrame, embedding: str, label: str, k: int, seed: int) -> DataFrame:
    """Rows with ``fold`` scored by the head that did not see their fold; without folds by one head."""
    fitted = fit_logistic(df, embedding, label, "fold", k)
    # The head of a row's fold: its weights are one array of a literal table.
    table = F.array(*[F.array(*[F.lit(float(v)) for v in [*fitted[f].weights, fitted[f].bias]]) for f in range(k)])
    dim = len(fitted[0].weights)
    rows = df.withColumn("_w", F.get(table, F.col("fold")))
    z = F.aggregate(F.zip_with(F.col(embedding), F.slice("_w", 1, dim), lambda e, v: e.cast("double") * v), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("p_spoof", sigmoid(z + F.get("_w", F.lit(dim)))).drop("_w")


def _layered_by_fold(df: DataFrame, embedding: str, label: str, k: int, seed: int) -> DataFrame:
    heads = fit_layered(df, embedding, label, "fold", k, seed=seed)
    return df.withColumn("p_spoof", layered_score(heads, F.col(embedding), F.col("fold")))


# Name -> (fit on rows and return a function that scores rows, score rows by fold).
HEADS: dict[str, tuple[Callable, Callable]] = {
    "logistic": (lambda df, e, y, seed: lambda rows: fit_logistic(df, e, y)[0].score(rows, e), _logistic_by_fold),
    "mlp": (_fit_layered, _layered_by_fold),
}


def build_head(name: str = "logistic") -> tuple[Callable, Callable]:
    """Head by name; an unknown name lists the choices."""
    if name not in HEADS:
        raise ValueError(f"unknown head {name!r}; available: {sorted(HEADS)}")
    return HEADS[name]


def out_of_fold(df: DataFrame, embedding: str, label: str, key: str, *, head: str = "logistic",
                k: int = 5, seed: int = 42) -> DataFrame:
    """Every row scored once by a head that never saw it (H3)."""
    by_fold = build_head(head)[1]
    # Every pass of the optimiser reads the folds: write them once.
    folds = freeze(sampling.stratified_folds(df, label, [key], k, seed).select(key, label, embedding, "fold"))
    return by_fold(folds, embedding, label, k, seed).select(key, label, "fold", "p_spoof")


def adapt(train: DataFrame, test: DataFrame, embedding: str, label: str, key: str, *, head: str = "logistic",
          cross_fit: bool = True, k: int = 5, zero_shot: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Adapted scores and the EER check against the zero-shot score (H4)."""
    if cross_fit:
        scores = out_of_fold(train, embedding, label, key, head=head, k=k).drop("fold")
        base = train
    else:
        scores = build_head(head)[0](train, embedding, label, 42)(test).select(key, label, "p_spoof")
        base = test
    one = scores.withColumn("_all", F.lit(0))
    eer = metrics.equal_error_rate(one, ["_all"], "p_spoof", label).select("_all", F.col("eer").alias("eer_ad"))
    if zero_shot is not None:
        zs = metrics.equal_error_rate(base.withColumn("_all", F.lit(0)), ["_all"], zero_shot, label).select(
            "_all", F.col("eer").alias("eer_zs"))
        eer = eer.join(zs, "_all").withColumn("improved", F.col("eer_ad") < F.col("eer_zs"))
    check = eer.drop("_all").withColumn("mode", F.lit("crossfit" if cross_fit else "holdout")).withColumn("head", F.lit(head))
    return scores, check


def compare_heads(df: DataFrame, embedding: str, label: str, key: str, heads: Sequence[str] = ("logistic", "mlp"),
                  k: int = 5) -> DataFrame:
    """Out-of-fold EER per head (H5)."""
    parts = [out_of_fold(df, embedding, label, key, head=h, k=k).withColumn("head", F.lit(h)) for h in heads]
    return metrics.equal_error_rate(union_all(parts), ["head"], "p_spoof", label)


# --- surrogate --------------------------------------------------------------------------------

def fit_surrogate(df: DataFrame, features: Sequence[str], score: str, key: str, *, seed: int = 42,
                  trees: int = 400) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Forest that mimics a score; held-out R2 and rank correlation (H7)."""
    parts = sampling.holdout(df, [key], 0.3, seed)
    forest = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_x"),
        RandomForestRegressor(featuresCol="_x", labelCol=score, predictionCol="prediction",
                              numTrees=trees, seed=seed)])
    model = forest.fit(parts.filter(F.col("part") == "train"))
    held = parts.filter(F.col("part") == "test")
    return model, held, surrogate_fit(model.transform(held), score)


def surrogate_fit(predicted: DataFrame, score: str) -> DataFrame:
    rows = predicted.select(F.lit(0).alias("_all"), F.col(score).alias("y"), F.col("prediction").alias("p"))
    ranked = rows
    for c in ("y", "p"):
        ranked = ranked.join(average_ranks(rows, ["_all"], c).select("_all", c, F.col("rank").alias(f"r{c}")), ["_all", c])
    return ranked.agg(
        (1.0 - F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))) / (F.var_pop("y") * F.count("y"))).alias("r2"),
        F.corr("ry", "rp").alias("spearman"), F.count("y").alias("n"))


def permutation_importance(model: PipelineModel, held: DataFrame, features: Sequence[str], score: str, key: str, *,
                           seed: int = 42) -> DataFrame:
    """Rise of the squared error when one feature's values change places (H8).

    Places are exchanged by joining two hash orders on their position, for any number of rows.
    """
    rows = held.select(key, score, *features).withColumn("_all", F.lit(0))
    here = hash_positions(rows, ["_all"], md5_key(F.lit(f"{seed}a"), key), "_pos")
    def error(df: DataFrame, name: str) -> DataFrame:
        p = model.transform(df)
        return p.agg(F.avg((F.col(score) - F.col("prediction")) * (F.col(score) - F.col("prediction"))).alias("mse")).select(
            F.lit(name).alias("feature"), "mse")
    base = error(rows, "").select(F.col("mse").alias("_base"), F.lit(0).alias("_k"))
    parts = []
    for f in features:
        other = hash_positions(rows.select(key, "_all", F.col(f).alias("_moved")), ["_all"],
                               md5_key(F.lit(f"{seed}b{f}"), key), "_pos").select("_pos", "_moved")
        parts.append(error(here.join(other, "_pos").withColumn(f, F.col("_moved")), f))
    out = union_all(parts).withColumn("_k", F.lit(0)).join(F.broadcast(base), "_k")
    return out.select("feature", (F.col("mse") - F.col("_base")).alias("importance"))
