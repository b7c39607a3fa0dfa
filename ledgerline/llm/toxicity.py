"""Toxicity by a classifier chain: a linear model for each category, later ones also see earlier probabilities.

While the chain is fitted, the probabilities that later models learn from are out-of-fold: each row's come from
models that have not seen the row. In use they come from the final models, so both are of the same kind.
Features are beginnings of words, as hashes; no words are kept. The models are fitted on a bounded sample of the
labelled rows, in one task, and applied to every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.batches import begin_task, slices, texts
from ledgerline.session import fresh_path, write_and_read

SAMPLE_ROWS = 20_000
LEAST_DOCUMENTS = 5
FOLDS = 3
REGULARIZATION = 1e-5
ITERATIONS = 30
TOLERANCE = 1e-6
MEMORY = 6  # steps that the optimizer remembers
BEGINNINGS = (4, 5, 6)
RUNS = re.compile(r"[^\W_]+")
KEPT_WORDS = 200_000
BLOCK = 1 << 21  # feature numbers that are worked on at a time
LIMIT = 8.0  # of log-odds that are handed on, so that one sure model does not drown the features


def features_of(word: str) -> list[int]:
    """The features of a blank-separated word, as 32-bit hashes: the beginnings of its runs of letters and digits in lower
    case, so that endings of their own do not hide a word; short runs, and words without runs, as they are."""
    names = set()
    for run in RUNS.findall(word.lower()) or [word]:
        names |= {run[:n] for n in BEGINNINGS} if len(run) > BEGINNINGS[0] else {run}
    return [zlib.crc32(name.encode("utf-8", "replace")) for name in names]


class Words:
    """The features of texts, by words, of which a bounded number is remembered. With ``columns``, ascending features,
    their places in these instead, and no others."""

    def __init__(self, columns: np.ndarray | None = None) -> None:
        self.columns, self.known = columns, {}

    def of_text(self, text: str) -> np.ndarray:
        """The distinct features of a text, ascending."""
        words = set(text.split())
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        if new := [word for word in words if word not in known]:
            features = [features_of(word) for word in new]
            ends = np.cumsum([0, *map(len, features)])
            found = np.fromiter(chain.from_iterable(features), np.uint32, ends[-1])
            if self.columns is not None:
                at = np.searchsorted(self.columns, found)
                at[at == len(self.columns)] = 0
                real = self.columns[at] == found if len(self.columns) else np.zeros(len(found), bool)
                found, ends = at[real].astype(np.uint32), np.concatenate([[0], np.cumsum(real)])[ends]
            ends = ends.tolist()
            known.update((word, found[start:end]) for word, start, end in zip(new, ends, ends[1:], strict=False))
        return np.unique(np.concatenate([known[word] for word in words])) if words else np.zeros(0, np.uint32)


@dataclass
class Chain:
    """``columns``: the features that have weights, ascending. For each category its weights of these, those of earlier
    log-odds, its intercept. ``threshold``: the probability of the last one with the fewest errors out of fold."""

    categories: list[str]
    columns: np.ndarray
    weights: np.ndarray
    earlier: list[np.ndarray]
    intercepts: list[float]
    threshold: float = 0.5
    fitted: bool = True

    def probabilities(self, places: Sequence[np.ndarray]) -> np.ndarray:
        """Categories by column, a row for each set of places in ``columns``."""
        odds = np.zeros((len(places), len(self.categories)))
        sums = np.array([self.weights[:, at].sum(axis=1) for at in places]).reshape(len(places), -1)
        for k in range(len(self.categories)):
            odds[:, k] = np.clip(sums[:, k] + self.intercepts[k] + odds[:, :k] @ self.earlier[k], -LIMIT, LIMIT)
        return 1 / (1 + np.exp(-odds))


class Rows:
    """The features of the sample as one array, with the products that fitting needs, worked out block by block.

    ``columns`` are the features that at least LEAST_DOCUMENTS rows have; only these are fitted.
    """

    def __init__(self, features: Iterable[np.ndarray]):
        features = list(features)
        found, counts = np.unique(np.concatenate([*features, np.zeros(0, np.uint32)]), return_counts=True)
        self.columns = found[counts >= LEAST_DOCUMENTS]
        del found, counts
        for i, numbers in enumerate(features):
            at = np.searchsorted(self.columns, numbers)
            features[i] = at[np.isin(numbers, self.columns, assume_unique=True)].astype(np.int32)
        sizes = np.array([len(numbers) for numbers in features], np.int64)
        self.ends = np.cumsum(sizes)
        self.numbers = np.concatenate([*features, np.zeros(0, np.int32)]).astype(np.int32)
        self.blocks = []
        start = 0
        while start < len(features):
            begin = self.ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(self.ends, begin + BLOCK, side="right")))
            self.blocks.append((start, stop, int(begin), int(self.ends[stop - 1]), sizes[start:stop]))
            start = stop

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = []
        for start, stop, begin, end, sizes in self.blocks:
            summed = np.concatenate([[0.0], np.cumsum(weights[self.numbers[begin:end]])])
            ends = self.ends[start:stop] - begin
            out.append(summed[ends] - summed[ends - sizes])
        return np.concatenate([*out, np.zeros(0)])

    def summed(self, of_rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.columns))
        for start, stop, begin, end, sizes in self.blocks:
            out += np.bincount(self.numbers[begin:end], np.repeat(of_rows[start:stop], sizes), len(self.columns))
        return out


def minimum(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray) -> np.ndarray:
    """Where a smooth convex function is least, by limited-memory BFGS with halved steps."""
    value, slope = value_and_slope(at)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ITERATIONS):
        way, shares = slope.copy(), []
        for move, turn, inner in reversed(moves):
            shares.append(move @ way / inner)
            way -= shares[-1] * turn
        if moves:
            move, turn, inner = moves[-1]
            way *= inner / (turn @ turn)
        for (move, turn, inner), share in zip(moves, reversed(shares), strict=True):
            way += (share - turn @ way / inner) * move
        step, fall = (1.0 if moves else 1 / max(1.0, np.linalg.norm(slope))), slope @ way
        while True:
            there = at - step * way
            new_value, new_slope = value_and_slope(there)
            if new_value <= value - 1e-4 * step * fall or step < 1e-10:
                break
            step /= 2
        move, turn = there - at, new_slope - slope
        if (inner := move @ turn) > 1e-12:
            moves = [*moves[1 - MEMORY :], (move, turn, inner)]
        done = step < 1e-10 or value - new_value < TOLERANCE * value
        at, value, slope = there, new_value, new_slope
        if done:
            break
    return at


def regression(rows: Rows, earlier: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on the rows ``used``: of the features, of earlier log-odds, and the intercept."""
    sign, n, k = np.where(y > 0, 1.0, -1.0), len(rows.columns), earlier.shape[1]
    share = used / used.sum()
    rate = share @ (y > 0)
    if 0 < rate < 1:  # both classes weigh the same, however rare one is
        share = share * np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))

    def value_and_slope(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = sign * (rows.times(w[:n]) + earlier @ w[n : n + k] + w[-1])
        value = share @ np.logaddexp(0, -margin) + REGULARIZATION / 2 * (w[:-1] @ w[:-1])
        error = -share * sign / (1 + np.exp(np.minimum(margin, 500)))
        slope = np.concatenate([rows.summed(error), error @ earlier, [error.sum()]])
        slope[:-1] += REGULARIZATION * w[:-1]
        return value, slope

    start = np.zeros(n + k + 1)
    start[-1] = 0.0 if 0 < rate < 1 else np.sign(rate - 0.5) * LIMIT
    return minimum(value_and_slope, start)


def fit_chain(rows: Rows, labels: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The weights of each category's model, and the log-odds of each row by models of other folds, by category, which
    are what later models learn from."""
    odds, n = np.zeros((len(labels), 0)), len(rows.columns)
    out = []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        out.append(regression(rows, odds, y, np.ones(len(y))))
        own = np.zeros(len(y))
        for fold in range(FOLDS):
            others = (folds != fold).astype(float)
            if not (folds == fold).any():
                continue
            w = regression(rows, odds, y, others if others.any() else np.ones(len(y)))
            own = np.where(folds == fold, rows.times(w[:n]) + odds @ w[n:-1] + w[-1], own)
        odds = np.column_stack([odds, np.clip(own, -LIMIT, LIMIT)])
    return out, odds


def fewest_errors(odds: np.ndarray, y: np.ndarray) -> float:
    """The log-odds from which on rows are taken for positive with the fewest errors; the middle of the widest gap."""
    order = np.argsort(odds, kind="stable")
    odds, y = odds[order], y[order] > 0
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum(~y[::-1])[::-1], [0]])
    low, high = np.concatenate([[odds[0] - 2], odds]), np.concatenate([odds, [odds[-1] + 2]])
    apart = np.flatnonzero(low < high)  # rows of equal odds are on one side
    least = apart[errors[apart] == errors[apart].min()]
    best = least[np.argmax((high - low)[least])]
    return float(low[best] + high[best]) / 2


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Chain:
    """The chain over the label columns ``categories`` (0 or 1) in their order; not fitted if no row has all labels.

    At most ``sample_rows`` labelled ids are used, those with the smallest hash, so the choice depends on no
    order. Of labels repeated for an id the largest counts, of texts repeated for an id one. One task holds the
    distinct features of the sample and fits all models. Features that LEAST_DOCUMENTS rows of it have get weights; a
    hash and a weight for each category, bounded by the sample, are what comes to the driver and goes to the tasks.
    """
    spark, count = docs.sparkSession, len(categories)
    known = labels.select(F.col(id_col).alias("id"), *(F.col(f"`{c}`").cast("double").alias(f"y{i}") for i, c in enumerate(categories))).dropna()
    known = known.groupBy("id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(count)))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    of_sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    read = of_sample.groupBy("id", *(f"y{i}" for i in range(count))).agg(F.max("text").alias("text"))
    read = read.select(F.xxhash64("id").alias("at"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"), F.array(*(f"y{i}" for i in range(count))).alias("y"), F.col("text").cast("binary").alias("body"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(__name__)
        words = Words()
        for batch in batches:
            for part in slices(batch):
                packed = [words.of_text(text).tobytes() for text in texts(part)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(packed, pa.binary())], names=["at", "fold", "y", "features"])

    rows = write_and_read(read.mapInArrow(numbered, "at long, fold int, y array<double>, features binary"), fresh_path(spark, "toxicity-sample"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(__name__)
        folds, y, features = [], [], []
        for batch in batches:
            folds += batch.column("fold").to_pylist()
            y += batch.column("y").to_pylist()
            features += [np.frombuffer(packed, np.uint32) for packed in batch.column("features").to_pylist()]
        if not folds:
            return
        held = Rows(features)
        del features
        models, odds = fit_chain(held, np.array(y), np.array(folds))
        border = fewest_errors(odds[:, -1], np.array(y)[:, -1])
        for k, w in enumerate(models):
            n = len(held.columns)
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "columns": pa.array([held.columns.tobytes() if k == 0 else None], pa.binary()), "weights": pa.array([w[:n].tobytes()], pa.binary()), "others": pa.array([w[n:].tolist()], pa.list_(pa.float64())), "border": pa.array([border])})

    models = rows.coalesce(1).sortWithinPartitions("at").mapInArrow(fitted, "k int, columns binary, weights binary, others array<double>, border double")
    found = sorted(models.collect(), key=lambda row: row["k"])
    if not found:
        return Chain(list(categories), np.zeros(0, np.uint32), np.zeros((count, 0)), [], [], fitted=False)
    weights = np.stack([np.frombuffer(row["weights"]) for row in found])
    return Chain(list(categories), np.frombuffer(found[0]["columns"], np.uint32), weights, [np.array(row["others"][:-1]) for row in found], [row["others"][-1] for row in found], 1 / (1 + np.exp(-found[0]["border"])))


def predict(docs: DataFrame, fitted: Chain, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` (double) for each category and ``toxic`` (boolean), the last one's decision:
    from ``threshold`` on, or from the one that made the fewest errors out of fold.

    Whole texts are read. Null and empty texts have no features and get what the intercepts say. Without a
    fitted chain the probabilities are null and nothing is toxic. Rows and their other columns stay as they are;
    columns with the new names are replaced.
    """
    added = [f"p_{category}" for category in fitted.categories]
    names = [name for name in docs.columns if name not in (*added, "toxic")]
    if not fitted.fitted:
        nothing = [F.lit(None).cast("double").alias(name) for name in added]
        return docs.select(*(F.col(f"`{name}`") for name in names), *nothing, F.lit(False).alias("toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(__name__)
        words = Words(shared.value.columns)
        for batch in batches:
            body = pa.RecordBatch.from_arrays([*batch.columns, batch.column(at).cast(pa.binary())], names=[*map(str, range(batch.num_columns)), "body"])
            for part in slices(body):
                p = shared.value.probabilities([words.of_text(text) for text in texts(part)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(p[:, k], pa.float64()) for k in range(p.shape[1]))], names=[*names, *added])

    kept = docs.select(*(F.col(f"`{name}`").cast("string").alias(name) if name == text_col else F.col(f"`{name}`") for name in names))
    schema = T.StructType([*kept.schema, *(T.StructField(name, T.DoubleType()) for name in added)])
    return kept.mapInArrow(run, schema).withColumn("toxic", F.col(f"`{added[-1]}`") >= (fitted.threshold if threshold is None else threshold))


def remove_toxic(docs: DataFrame, labels: DataFrame, categories: Sequence[str], threshold: float | None = None) -> DataFrame:
    """The documents that the chain does not reject, with their columns."""
    marked = predict(docs, fit(docs, labels, categories), threshold)
    return marked.where(~F.col("toxic")).select(*(F.col(f"`{name}`") for name in docs.columns))

