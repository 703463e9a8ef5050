"""Models trained by sums over Spark: squared-hinge linear SVC (M4) and a mini-batch perceptron (M9).

Rows stay in their partitions; a pass sends the weights to the tasks, which return one sum each
(loss, gradient, curvature), and many partitions' sums are added in a tree.  The driver
holds weights and sums of their size only.

* ``SquaredHingeSVC``: the reference library's linear SVC, ½(‖w‖² + b²) + C·Σ max(0, 1 − y·f)²,
  by trust-region Newton steps.  Hessian-vector products are passes over the rows; with at most
  DENSE weights one pass sums the Hessian itself and the products are taken from it.
* ``NewtonLogistic``: logistic regression, ½‖w‖² + C·Σ log(1 + exp(−y·f)), by the same steps on the
  features as they are.  MLlib's works on features divided by their deviations, where rare n-grams
  make the penalty so uneven that it does not get near the optimum in hundreds of passes.
* ``MiniBatchMlp``: one hidden layer, dropout, cross-entropy, Adam with decoupled weight decay,
  early stop.  Data-parallel and synchronous: rows are dealt at random to partitions and packed
  into blocks of ``batch`` rows; a step takes one block of every partition, in another order each
  epoch, and one Adam step on their mean gradient.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a batch of rows worked on at a time: a batch is of up to 10,000 rows, however long.
VALUES = 1 << 20
#: Weights up to which the Hessian is summed whole; partial sums that the driver adds itself.
DENSE, TOGETHER = 512, 64


def _total(parts: DataFrame, schema: str, n: int) -> tuple:
    """The sum of the rows, one a partition of ``n``, of numbers and binary float64 arrays, in a tree."""
    names = parts.columns  # not the table itself, which tasks cannot hold

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                row = [np.frombuffer(x, np.float64) if isinstance(x, bytes) else x for x in row]
                total = row if total is None else [x + y for x, y in zip(total, row)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x]) for x in total], names)

    while n > TOGETHER:
        n = math.isqrt(n)
        parts = parts.repartition(n).mapInArrow(add, schema)
    total = None
    for r in parts.collect():  # at most TOGETHER rows
        row = [np.frombuffer(bytes(x), np.float64) if isinstance(x, (bytes, bytearray)) else x for x in r]
        total = row if total is None else [x + y for x, y in zip(total, row)]
    return tuple(total) if total is not None else ()


# ------------------------------------------------------------------ linear SVC

def sparse_rows(df: DataFrame, keep: list[str], vector: str = "features") -> DataFrame:
    """``keep`` with idx and val of a vector column (idx null where vectors are dense)."""
    first = df.select(vector).first()
    if first is not None and isinstance(first[0], SparseVector):
        parts = F.udf(lambda v: (v.indices.tolist(), v.values.tolist()), "idx array<int>, val array<double>")
        return df.select(*keep, parts(F.col(vector)).alias("p")).select(*keep, "p.idx", "p.val")
    return df.select(*keep, F.lit(None).cast("array<int>").alias("idx"), vector_to_array(vector).alias("val"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with at most VALUES values together, one row at least."""
    for b in batches:
        ends, lo = b.column("val").offsets.to_numpy(), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + VALUES, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


class _Rows:
    """A batch of dense or sparse rows: products with a weight per feature, and with one per row."""

    def __init__(self, b: pa.RecordBatch, d: int) -> None:
        val, idx, self.d, self.n = b.column("val"), b.column("idx"), d, b.num_rows
        flat = val.flatten().to_numpy(zero_copy_only=False)
        self.x = flat.reshape(self.n, d) if idx.null_count else None
        if self.x is None:
            self.flat, self.col = flat, idx.flatten().to_numpy(zero_copy_only=False)
            self.row = np.repeat(np.arange(self.n), np.diff(val.offsets.to_numpy()))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w if self.x is not None else np.bincount(self.row, self.flat * w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return self.x.T @ r if self.x is not None else np.bincount(self.col, self.flat * r[self.row], self.d)

    def gram(self, on: np.ndarray) -> np.ndarray:
        x = self.x
        if x is None:
            x = np.zeros((self.n, self.d))
            np.add.at(x, (self.row, self.col), self.flat)
        x = np.append(x, np.ones((self.n, 1)), 1)[on]
        return x.T @ x


def _svc_pass(theta: np.ndarray, d: int, want: str, v: np.ndarray | None = None):
    """Sums over rows at weights ``theta`` (bias last): loss and gradient, with the Hessian's rows (``hessian``),
    or the Hessian times ``v`` (``product``); without the factor C."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, extra = 0.0, np.zeros(d + 1), np.zeros((d + 1) ** 2 if want == "hessian" else 0)
        for b in _parts(batches):
            x, y = _Rows(b, d), np.where(b.column("y").to_numpy() > 0, 1.0, -1.0)
            slack = 1 - y * (x.dot(theta[:-1]) + theta[-1])
            on = slack > 0
            if want == "product":
                r = np.where(on, 2 * (x.dot(v[:-1]) + v[-1]), 0.0)
            else:
                loss += float((slack[on] ** 2).sum())
                r = np.where(on, -2 * y * slack, 0.0)
                if want == "hessian":
                    extra = extra + 2 * x.gram(on).ravel()
            grad[:-1] += x.back(r)
            grad[-1] += r.sum()
        yield pa.RecordBatch.from_pydict({"loss": [loss], "grad": [grad.tobytes()], "extra": [extra.tobytes()]})
    return run


def _logistic_pass(theta: np.ndarray, d: int, want: str, v: np.ndarray | None = None):
    """The same of the logistic loss, without ``hessian``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad = 0.0, np.zeros(d + 1)
        for b in _parts(batches):
            x, y = _Rows(b, d), np.where(b.column("y").to_numpy() > 0, 1.0, -1.0)
            margin = y * (x.dot(theta[:-1]) + theta[-1])
            wrong = np.exp(-np.logaddexp(0, margin))  # the probability of the other class
            if want == "product":
                r = wrong * (1 - wrong) * (x.dot(v[:-1]) + v[-1])
            else:
                loss += float(np.logaddexp(0, -margin).sum())
                r = -y * wrong
            grad[:-1] += x.back(r)
            grad[-1] += r.sum()
        yield pa.RecordBatch.from_pydict({"loss": [loss], "grad": [grad.tobytes()], "extra": [b""]})
    return run


_SVC = "loss double, grad binary, extra binary"


def steihaug(g: np.ndarray, product: Callable[[np.ndarray], np.ndarray], radius: float, tol: float = 0.1, most: int = 200) -> np.ndarray:
    """The step of a trust-region method: conjugate gradients for H s = -g inside the radius."""
    s, r = np.zeros_like(g), -g
    p, rr = r.copy(), float(r @ r)
    stop = tol * math.sqrt(rr)
    for _ in range(most):
        if math.sqrt(rr) <= stop:
            break
        hp = product(p)
        alpha = rr / float(p @ hp)
        if float(np.linalg.norm(s + alpha * p)) >= radius:
            a, b, c = float(p @ p), 2 * float(s @ p), float(s @ s) - radius * radius
            return s + (-b + math.sqrt(max(b * b - 4 * a * c, 0))) / (2 * a) * p
        s = s + alpha * p
        r = r - alpha * hp
        rr, old = float(r @ r), rr
        p = r + rr / old * p
    return s


class SquaredHingeSVC:
    """``fit`` gives a model whose ``transform`` adds prediction and rawPrediction, as MLlib's do."""

    one_pass, bias_penalty = staticmethod(_svc_pass), 1.0

    def __init__(self, c: float = 1.0, tol: float = 1e-4, max_iter: int = 5000, dense: int = DENSE) -> None:
        self.c, self.tol, self.max_iter, self.dense = c, tol, max_iter, dense

    def model(self, theta: np.ndarray, steps: int) -> "SquaredHingeModel":
        return SquaredHingeModel(theta[:-1], float(theta[-1]), steps)

    def fit(self, df: DataFrame) -> "SquaredHingeModel":
        one_pass = self.one_pass
        d = df.select("features").first()[0].size
        rows = sparse_rows(df, ["y"]).persist()
        parts = rows.rdd.getNumPartitions()
        theta, penalty = np.zeros(d + 1), np.append(np.ones(d), self.bias_penalty)
        whole = "hessian" if d <= self.dense else "gradient"
        n_pos, n = rows.agg(F.sum((F.col("y") > 0).cast("long")), F.count("*")).first()

        def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            loss, grad, extra = _total(rows.mapInArrow(one_pass(at, d, whole), _SVC), _SVC, parts)
            return 0.5 * float(at @ (penalty * at)) + self.c * loss, penalty * at + self.c * grad, extra.reshape(d + 1, d + 1) if extra.size else extra

        f, g, h = sums(theta)
        first = radius = float(np.linalg.norm(g))
        enough = self.tol * max(min(n_pos, n - n_pos), 1) / n * first
        steps = 0
        while float(np.linalg.norm(g)) > enough and steps < self.max_iter:
            if h.size:
                product = lambda v, h=h: penalty * v + self.c * (h @ v)
            else:
                product = lambda v, at=theta: penalty * v + self.c * _total(rows.mapInArrow(one_pass(at, d, "product", v), _SVC), _SVC, parts)[1]
            s = steihaug(g, product, radius, tol=1e-8 if h.size else 0.1)
            foreseen = -(float(g @ s) + 0.5 * float(s @ product(s)))
            f2, g2, h2 = sums(theta + s)
            gain = (f - f2) / foreseen if foreseen > 0 else 0.0
            length = float(np.linalg.norm(s))
            radius = 0.25 * length if gain < 0.25 else max(radius, 2 * length) if gain > 0.75 else radius
            if gain > 1e-4:
                theta, f, g, h = theta + s, f2, g2, h2
            elif length <= 1e-12 * max(1.0, float(np.linalg.norm(theta))):
                break
            steps += 1
        rows.unpersist()
        return self.model(theta, steps)


class SquaredHingeModel:
    def __init__(self, weights: np.ndarray, intercept: float, steps: int) -> None:
        self.weights, self.intercept, self.steps = weights, intercept, steps

    def transform(self, df: DataFrame) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self.weights)  # of the size of the model
        bias, keep = self.intercept, df.columns
        rows = sparse_rows(df.select(F.struct(*[df[c] for c in keep if c != "features"]).alias("_row"), "features"), ["_row"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _parts(batches):
                yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(_Rows(b, len(held.value)).dot(held.value) + bias)], ["_row", "f"])

        schema = rows.select("_row").schema.add("f", "double")
        out = rows.mapInArrow(run, schema)
        return out.select("_row.*", (F.col("f") > 0).cast("double").alias("prediction"), array_to_vector(F.array(-F.col("f"), F.col("f"))).alias("rawPrediction"))


class NewtonLogistic(SquaredHingeSVC):
    """``fit`` gives a model whose ``transform`` adds prediction and probability; the intercept has no penalty."""

    one_pass, bias_penalty = staticmethod(_logistic_pass), 0.0

    def __init__(self, c: float = 1.0, tol: float = 1e-4, max_iter: int = 2000) -> None:
        super().__init__(c, tol, max_iter, dense=0)

    def model(self, theta: np.ndarray, steps: int) -> "NewtonLogisticModel":
        return NewtonLogisticModel(theta[:-1], float(theta[-1]), steps)


class NewtonLogisticModel(SquaredHingeModel):
    def transform(self, df: DataFrame) -> DataFrame:
        out = super().transform(df)
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        return out.withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("rawPrediction")


# ------------------------------------------------------------------ perceptron

def unpack(theta: np.ndarray, d: int, hidden: int) -> tuple[np.ndarray, ...]:
    at = np.cumsum([d * hidden, hidden, hidden * 2])
    w1, b1, w2, b2 = np.split(theta, at)
    return w1.reshape(d, hidden), b1, w2.reshape(hidden, 2), b2


def forward(theta: np.ndarray, x: np.ndarray, hidden: int, keep: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(hidden values, probability of each class); ``keep``: the dropout mask, scaled."""
    w1, b1, w2, b2 = unpack(theta, x.shape[1], hidden)
    a = np.maximum(x @ w1 + b1, 0) * keep
    z = a @ w2 + b2
    z = np.exp(z - z.max(1, keepdims=True))
    return a, z / z.sum(1, keepdims=True)


def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int, keep: np.ndarray | float = 1.0) -> tuple[float, np.ndarray]:
    """Sums over rows of the cross-entropy and of its gradient."""
    a, p = forward(theta, x, hidden, keep)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
    p[np.arange(len(y)), y] -= 1
    _, _, w2, _ = unpack(theta, x.shape[1], hidden)
    back = (p @ w2.T) * keep * (a > 0)
    return loss, np.concatenate([(x.T @ back).ravel(), back.sum(0), (a.T @ p).ravel(), p.sum(0)])


class Adam:
    def __init__(self, size: int, rate: float, decay: float) -> None:
        self.rate, self.decay, self.m, self.v, self.t = rate, decay, np.zeros(size), np.zeros(size), 0

    def step(self, theta: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        m, v = self.m / (1 - 0.9 ** self.t), self.v / (1 - 0.999 ** self.t)
        return theta * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + 1e-8)


_BLOCK = "k int, n int, x binary, y binary"
_GRAD = "n long, loss double, grad binary"


def _pack(batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, k = [], [], 0
        for b in batches:
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                xs.append(x)
                ys.append(y)
                if len(xs) == batch:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(xs)], pa.int32()), pa.array([np.array(xs, np.float64).tobytes()]), pa.array([np.array(ys, np.int64).tobytes()])], ["k", "n", "x", "y"])
                    xs, ys, k = [], [], k + 1
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(xs)], pa.int32()), pa.array([np.array(xs, np.float64).tobytes()]), pa.array([np.array(ys, np.int64).tobytes()])], ["k", "n", "x", "y"])
    return run


class MiniBatchMlp:
    """``fit`` returns the weights of the epoch with the least validation loss and the history."""

    def __init__(self, hidden: int = 256, dropout: float = 0.2, rate: float = 5e-4, decay: float = 1e-4, batch: int = 64,
                 epochs: int = 40, patience: int = 8, seed: int = 42) -> None:
        self.hidden, self.dropout, self.rate, self.decay, self.batch = hidden, dropout, rate, decay, batch
        self.epochs, self.patience, self.seed = epochs, patience, seed

    def start(self, d: int) -> np.ndarray:
        """Uniform weights within 1/sqrt(inputs) of a layer."""
        rng = np.random.default_rng(self.seed)
        a, b = 1 / math.sqrt(d), 1 / math.sqrt(self.hidden)
        return np.concatenate([rng.uniform(-a, a, d * self.hidden + self.hidden), rng.uniform(-b, b, self.hidden * 2 + 2)])

    def blocks(self, df: DataFrame) -> DataFrame:
        """Rows (pos, y, features) dealt at random, ``batch`` a block; a partition's blocks are numbered."""
        n = df.count()
        parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-n // self.batch)))
        mixed = F.xxhash64("pos", F.lit(self.seed))
        rows = df.select(mixed.alias("r"), "pos", vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"))
        return rows.repartition(parts, "r").sortWithinPartitions("r", "pos").select("x", "y").mapInArrow(_pack(self.batch), _BLOCK)

    def _sums(self, blocks: DataFrame, parts: int, theta: np.ndarray, step: int | None) -> tuple[int, float, np.ndarray]:
        """(rows, loss, gradient) of blocks; with dropout, drawn by step and partition, in training."""
        hidden, drop, seed = self.hidden, self.dropout, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n, loss, grad = TaskContext.get().partitionId(), 0, 0.0, np.zeros(len(theta))
            for b in batches:
                for k, m, x, y in zip(*(b.column(c).to_pylist() for c in ("k", "n", "x", "y"))):
                    x, y, keep = np.frombuffer(x, np.float64).reshape(m, -1), np.frombuffer(y, np.int64), 1.0
                    if step is not None and drop:
                        keep = (np.random.default_rng([seed, step, part, k]).random((m, hidden)) >= drop) / (1 - drop)
                    more, g = gradient(theta, x, y, hidden, keep)
                    n, loss, grad = n + m, loss + more, grad + g
            if n:
                yield pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "grad": [grad.tobytes()]})

        return _total(blocks.mapInArrow(run, _GRAD), _GRAD, parts) or (0, 0.0, np.zeros(len(theta)))

    def fit(self, train: DataFrame, val: DataFrame) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
        blocks, held = self.blocks(train).persist(), self.blocks(val).persist()
        most = blocks.agg(F.max("k")).first()[0]
        parts, held_parts = blocks.rdd.getNumPartitions(), held.rdd.getNumPartitions()
        d = train.select("features").first()[0].size
        theta = self.start(d)
        adam = Adam(len(theta), self.rate, self.decay)
        best, best_theta, bad, step, history = math.inf, theta, 0, 0, []
        for epoch in range(1, self.epochs + 1):
            rows, total = 0, 0.0
            for k in np.random.default_rng([self.seed, epoch]).permutation(most + 1).tolist():
                n, loss, grad = self._sums(blocks.where(F.col("k") == k), parts, theta, step)
                theta, step, rows, total = adam.step(theta, grad / n), step + 1, rows + n, total + loss
            n, loss, _ = self._sums(held, held_parts, theta, None)
            seen = loss / n if n else total / rows
            history.append((epoch, total / rows, seen))
            if seen < best - 1e-12:
                best, best_theta, bad = seen, theta, 0
            else:
                bad += 1
                if bad >= self.patience:
                    break
        blocks.unpersist()
        held.unpersist()
        return best_theta, history

    def predict(self, theta: np.ndarray, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` with ``p1``, the probability of class 1."""
        held, hidden = df.sparkSession.sparkContext.broadcast(theta), self.hidden  # of the size of the model
        rows = df.select(F.struct(*keep).alias("_row"), vector_to_array("features").alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(np.ascontiguousarray(forward(held.value, x, hidden)[1][:, 1]))], ["_row", "p1"])

        return rows.mapInArrow(run, rows.select("_row").schema.add("p1", "double")).select("_row.*", "p1")
