"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's hashed tokens share one weight vector, and the grades 0 .. K-1 are parted by K-1 ordered thresholds:
P(grade > k) = sigmoid(score - threshold_k). Expected grade and the probability of at least a wanted
grade follow from one score, and selection cuts on that tail probability.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.shared import broadcast_parameter, first_row, free_name, once_per_worker, tidy

#: Weights; tokens are hashed into so many.
BUCKETS = 1 << 16
#: The most labelled rows that a fit uses; they are chosen by a hash of the id.
FIT_ROWS = 12_000
#: Bytes of a block of labelled rows; a step's temporary arrays are of this order.
BLOCK_BYTES = 8 << 20
#: Tokens whose bucket a Python worker keeps; the memory is dropped when it is full.
TOKEN_MEMORY = 200_000
#: Longer tokens seldom come again and are not kept.
LONG_TOKEN = 24

#: What tokens are: words with the marks that touch them apart.
TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")


#: Beginnings of words that are tokens too, by their length.
PREFIXES = (4, 5, 6, 7)


class _Hash(dict):
    """Buckets of each token and its beginnings, remembered. Words count without case; capitals leave a mark instead."""

    def __missing__(self, token: str) -> bytes:
        if len(self) >= TOKEN_MEMORY:
            self.clear()
        own = [token.lower()]
        if token[0].isalpha():
            own += [f"{own[0][:n]}-" for n in PREFIXES if len(token) > n] + ["^"] * (len(token) > 1 and token.isupper())
        out = array("i", [1 + xxhash.xxh32_intdigest(x.encode()) % (BUCKETS - 1) for x in own]).tobytes()
        if len(token) <= LONG_TOKEN:
            self[token] = out
        return out


def features(text: str | None, memory: _Hash) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's tokens, and how often each occurs, damped by a logarithm.

    Bucket 0 is kept for repetition: the logarithm of how often tokens occur on average.
    """
    tokens = TOKENS.findall(text or "")
    at, count = np.unique(np.frombuffer(b"".join(map(memory.__getitem__, tokens)), np.int32), return_counts=True)
    value = np.log1p(count).astype(np.float32)
    if tokens:
        at, value = np.append(at, 0).astype(np.int32), np.append(value, np.float32(math.log(len(tokens) / len(set(tokens)))))
    return at, value


@dataclass
class OrdinalModel:
    """Weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


@dataclass
class _Block:
    """Hashed rows: the entries of one after those of another."""

    grades: np.ndarray
    sizes: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def counts(self) -> tuple[int, np.ndarray]:
        """How many rows there are, and how many have each bucket."""
        return len(self.grades), np.bincount(self.at, minlength=BUCKETS)

    def narrow(self, used: np.ndarray) -> None:
        """Keep the entries of the buckets `used`, named by their place there: in the order of rows, and in that of buckets."""
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        at, doc = place[self.at], np.repeat(np.arange(len(self.grades), dtype=np.int32), self.sizes)
        own = at >= 0
        at, doc, value = at[own], doc[own], self.value[own]
        by = np.argsort(at, kind="stable")
        self.at = self.value = None
        self.n_used, self.by_row, self.by_bucket = len(used), (at, value, *_runs(doc)), (doc[by], value[by], *_runs(at[by]))

    def gradient(self, x: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows' summed log-likelihood, by the weights x of the used buckets and by thresholds."""
        n, k, grades = len(self.grades), len(cuts), self.grades
        score = _sums(x, *self.by_row, n)
        tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))
        upper = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
        i = np.arange(n)
        high, low = upper[i, grades], upper[i, grades + 1]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p  # of log p, by (score - cut)
        d_cut = np.zeros(k)
        np.add.at(d_cut, grades[grades > 0] - 1, -d_high[grades > 0])
        np.add.at(d_cut, grades[grades < k], d_low[grades < k])
        return _sums(d_high - d_low, *self.by_bucket, self.n_used), d_cut


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and their keys."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return begin, keys[begin]


def _sums(x: np.ndarray, index: np.ndarray, value: np.ndarray, begin: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """For each of n keys, the sum of value * x[index] over its run."""
    out = np.zeros(n)
    if len(begin):
        out[keys] = np.add.reduceat(value * x[index], begin)
    return out


#: What a step of the fit asks of each block, and the answers in the order of the blocks.
_Ask = Callable[[Callable], list]


def _maximise(ask: _Ask, n_grades: int, steps: int, rate: float, sparse: float, least_rows: int) -> OrdinalModel:
    w, gaps, k = np.zeros(BUCKETS), np.zeros(n_grades - 1), n_grades - 1
    found = ask(_Block.counts)
    if n := sum(f[0] for f in found):
        used = np.flatnonzero(sum(f[1] for f in found) >= min(least_rows, n))
        ask(partial(_Block.narrow, used=used))
        theta = np.zeros(len(used) + k)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            g = theta[-k:]
            parts = ask(partial(_Block.gradient, x=theta[:-k], cuts=np.cumsum(np.concatenate([g[:1], np.exp(g[1:])]))))
            after = np.cumsum(sum(d[1] for d in parts)[::-1])[::-1]
            grad = -np.concatenate([sum(d[0] for d in parts), after[:1], after[1:] * np.exp(g[1:])]) / n
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
            theta[:-k] = np.sign(theta[:-k]) * np.maximum(np.abs(theta[:-k]) - rate * sparse / (np.sqrt(v[:-k] / (1 - 0.999**step)) + 1e-10), 0)
        w[used], gaps = theta[:-k], theta[-k:]
    return OrdinalModel(w.astype(np.float32), np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:]) if n else gaps[1:]])))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, steps: int = 400, rate: float = 0.05, sparse: float = 1e-3, least_rows: int = 8) -> OrdinalModel:
    """Penalised maximum likelihood by full-batch Adam with an L1 step: weights that little speaks for stay 0, as do
    those of buckets that fewer than `least_rows` rows have. Thresholds are a first one and positive gaps, so they stay ordered.

    Without rows all weights are 0, and each tail is as likely as not.
    """
    blocks = [_Block(grades, np.array([len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))] if len(rows) else []
    return _maximise(lambda f: [f(b) for b in blocks], n_grades, steps, rate, sparse, least_rows)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Hashed rows as blocks of about BLOCK_BYTES."""
    rows, n_bytes = [], 0

    def block() -> _Block:
        own = np.array([r[0] for r in rows], np.int64), np.array([len(r[1]) // 4 for r in rows], np.int64)
        return _Block(*own, np.frombuffer(b"".join(r[1] for r in rows), np.int32), np.frombuffer(b"".join(r[2] for r in rows), np.float32))

    for b in batches:
        for row in zip(b.column("grade").to_pylist(), b.column("at").to_pylist(), b.column("value").to_pylist(), strict=True):
            rows.append(row)
            n_bytes += len(row[1]) + len(row[2])
            if n_bytes >= BLOCK_BYTES:
                yield block()
                rows, n_bytes = [], 0
    if rows:
        yield block()


def fit(df: DataFrame, ratings: DataFrame, n_grades: int, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", fit_rows: int = FIT_ROWS, steps: int = 400) -> OrdinalModel:
    """Fit on the documents that have a rating, at most `fit_rows` of the rated ids, those with the smallest id hashes.

    Of rows that share an id one teaches, chosen by a hash of its text. Ratings whose id or grade is null, or whose grade is outside 0 .. n_grades - 1, teach nothing; where
    an id has several ratings, the lowest counts. Texts become hashed tokens in the executors and are fitted by one
    task there, which the bound keeps small, so that the driver holds the weights only.
    """
    own = ratings.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{grade}`").cast("int").alias("grade"))
    own = own.where(F.col("id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("id").agg(F.min("grade").alias("grade"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rated = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(own), "id")
    # One row for each id, by a fixed rule: ids bound the rows of the fit, however often one is repeated.
    rated = first_row(rated, ["id"], ["id", "grade", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = once_per_worker("quality tokens", _Hash)
        for b in batches:
            rows = [features(t, memory) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("grade"), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())], ["id", "grade", "at", "value"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = list(_blocks(batches))
        model = _maximise(lambda f: [f(b) for b in blocks], n_grades, steps, 0.05, 1e-3, 8)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.thresholds)], ["weights", "thresholds"])

    found = rated.mapInArrow(tidy(hashed), "id string, grade int, at binary, value binary").repartition(1).sortWithinPartitions("id", "at", "value")
    model = found.mapInArrow(tidy(fitted), "weights binary, thresholds binary").collect()
    if not model:
        return fit_ordinal([], np.zeros(0, np.int64), n_grades)
    return OrdinalModel(np.frombuffer(model[0].weights, np.float32), np.frombuffer(model[0].thresholds))


def _scorer(shared: Broadcast, wanted: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    key = uuid.uuid4().hex

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: OrdinalModel = once_per_worker(("quality", key), lambda: OrdinalModel(*shared.value))
        memory = once_per_worker("quality tokens", _Hash)
        for batch in batches:
            scores = np.zeros(len(batch))
            for i, v in enumerate(batch):
                at, value = features(v.as_py(), memory)
                scores[i] = float(model.weights[at] @ value)
            tails = model.tails(scores)
            yield pa.StructArray.from_arrays([pa.array(scores), pa.array(tails.sum(1)), pa.array(tails[:, wanted - 1])], ["score", "expected", "tail"])

    return score


def score(df: DataFrame, model: OrdinalModel, wanted: int, text: str = "text", expected: str = "expected_grade", tail: str = "tail_probability") -> DataFrame:
    """Add the expected grade and the probability of a grade of `wanted` or more.

    A null or empty text has no tokens, so the thresholds alone decide. Rows and other columns stay, and
    columns of the two names are replaced; an empty table stays empty. Texts are scored whole, without a
    shuffle; the weights, of a fixed number, are broadcast.
    """
    shared = broadcast_parameter(df.sparkSession, (model.weights, model.thresholds), model.weights.nbytes)
    own = free_name(df, "scored")
    found = df.withColumn(own, F.arrow_udf(tidy(_scorer(shared, wanted)), "struct<score:double,expected:double,tail:double>")(F.col(f"`{text}`")))
    return found.withColumns({expected: F.col(f"{own}.expected"), tail: F.col(f"{own}.tail")}).drop(own)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels table: 2 is good and clean, 1 has one fault, 0 is both bad and toxic."""
    return labels.select("doc_id", ((F.col("quality") > 0).cast("int") + (F.col("toxic") == 0).cast("int")).alias("grade"))


def select(df: DataFrame, model: OrdinalModel, wanted: int, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of df, with its columns, whose probability of a grade of `wanted` or more is `least` at least.

    Null and empty texts are judged by the thresholds alone; repeated rows share their fate; an empty table stays empty.
    """
    own = free_name(df, "row"), free_name(df, "tail")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(own[0]), F.col(f"`{text}`").alias("text"))
    return score(rows, model, wanted, tail=own[1]).where(F.col(own[1]) >= least).select(f"{own[0]}.*")


def passes(tail: Column, least: float = 0.5) -> Column:
    """Whether a tail probability, which is never null, is `least` at least."""
    return tail >= least
