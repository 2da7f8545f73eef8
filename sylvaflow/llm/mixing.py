"""Mixing to target weights with soft membership.

A classifier fitted on labelled rows predicts for each document the posterior of each domain. The
rates r >= 0 then solve a least-squares problem: the expected tokens of domain k, the sum over
documents of r * tokens * posterior of k, shall be the target of k. Projected gradient steps find
them, r <- max(0, r - posterior . d), where d is the gradient of the domains' totals scaled by the
inverse of the sum of tokens * posterior * posterior' over documents with a rate above 0. So each
step is one aggregate over all documents of K + K * K sums, the documents' rates are never stored
between steps, and only the steps, K numbers each, go to the tasks.

The classifier is fitted on a bounded sample; its words are chosen by counts that are made in Spark, and of
the sample's texts only those words and their shape reach the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaflow.llm.tables import stored
from sylvaflow.llm.text import Words, by_bytes, distinct, list_array

DOMAINS = ("good", "low", "toxic")
#: Labelled rows that the classifier is fitted on, at most: those of least hash.
MAX_LABELLED = 4000
#: Words that it looks at, at most: those that tell most about the labels.
MAX_WORDS = 1024
#: Steps at most, and the share of all targets that may be missed without a warning.
STEPS, TOLERANCE = 50, 1e-6


def domain_of() -> Column:
    """The domain of a row of labels(quality, toxic); null where both are null."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)


def _shape(words: Words) -> np.ndarray:
    """Dense features of each text: size, share of symbols and of capitals among its bytes."""
    sizes = np.maximum(np.diff(words.rows), 1)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[words.rows]) / sizes
    symbols = np.isin(words.data, np.frombuffer(b"#*$%&|<>!", np.uint8))
    capitals = (words.data >= 65) & (words.data <= 90)
    return np.stack([np.log10(np.diff(words.first) + 1.0) / 4, 5 * per(symbols), 2 * per(capitals)], axis=1)


class Classifier:
    """Multinomial logistic regression on the presence of informative words and on _shape."""

    def __init__(self, words: np.ndarray, weights: np.ndarray):
        self.words, self.weights = words, weights

    @classmethod
    def fit(cls, words: np.ndarray, rows: list[tuple[int, np.ndarray, list[float]]]) -> "Classifier":
        """words: sorted hashes; rows: domain, places in `words` of a text's words, shape. Without rows all
        posteriors are equal; of a domain without rows the posterior is 0."""
        k = len(DOMAINS)
        if not rows:
            return cls(np.zeros(0, np.uint64), np.zeros((4, k)))
        y = np.array([r[0] for r in rows])
        class_size = np.bincount(y, minlength=k)
        x = np.zeros((len(rows), len(words) + 4), np.float32)
        for row, (_, places, shape) in zip(x, rows):
            row[places] = 1
            row[-4:-1], row[-1] = shape, 1
        target = np.eye(k, dtype=np.float32)[y]
        present = class_size > 0
        w = np.zeros((x.shape[1], k), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, 301):
            z = x @ w
            z[:, ~present] = -1e9
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (p - target) / len(rows) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[:, ~present], w[-1, ~present] = 0, -1e9
        return cls(words, w.astype(np.float64))

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and posteriors (rows x domains) of each text."""
        words = Words(column)
        n, size = len(words.rows) - 1, len(self.words)
        counts = np.diff(words.first)
        z = np.concatenate([_shape(words), np.ones((n, 1))], axis=1) @ self.weights[-4:]
        if size:
            spot = np.minimum(np.searchsorted(self.words, words.hash), size - 1)
            hit = np.flatnonzero(self.words[spot] == words.hash)
            pair = np.unique(np.repeat(np.arange(n), counts)[hit] * size + spot[hit])
            row, spot = pair // size, pair % size
            for k in range(z.shape[1]):
                z[:, k] += np.bincount(row, self.weights[spot, k], minlength=n)
        p = np.exp(z - z.max(1, keepdims=True))
        return counts, p / p.sum(1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_words: int = MAX_WORDS) -> Classifier:
    """Fits on at most `most` labelled rows and `most_words` words, those of greatest chi-square. Rows
    without label or document don't count; of a document's labels the last in DOMAINS does, and of rows
    that repeat its id the one with the least hash."""
    keyed = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of().alias("domain")).filter("doc_id is not null and domain is not null")
    keyed = keyed.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    sample = keyed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                words = Words(part.column("text"))
                own, first = distinct(words.hash, words.first)
                shape = _shape(words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), part.column("domain"), list_array(own.view(np.int64), first, pa.int64()), pa.array(shape.tolist(), pa.list_(pa.float64()))], ["doc_id", "h", "domain", "words", "shape"])

    # the sample's size is bounded by a parameter, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").join(F.broadcast(sample), "doc_id")
    found = texts.mapInArrow(features, "doc_id long, h long, domain int, words array<long>, shape array<double>")
    found = stored(found.groupBy("doc_id").agg(F.min_by(F.struct("domain", "words", "shape"), "h").alias("r")).select("r.*"), "sample")
    k = len(DOMAINS)
    sizes = {r.domain: r["count"] for r in found.groupBy("domain").count().collect()}
    total = max(sum(sizes.values()), 1)
    held = [F.count_if(F.col("domain") == d) for d in range(k)]
    table = found.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *(c.alias(f"n{d}") for d, c in enumerate(held)))
    expected = [F.col("n") * F.lit(sizes.get(d, 0) / total) for d in range(k)]
    score = reduce(lambda s, x: s + x, ((F.col(f"n{d}") - e) * (F.col(f"n{d}") - e) / F.greatest(e, F.lit(1e-9)) for d, e in enumerate(expected)))
    best = table.filter("n >= 4").withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "word").limit(most_words)
    chosen = np.sort(np.array([r.word for r in best.collect()], np.int64).view(np.uint64))
    signed = chosen.view(np.int64)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.sort(signed)
        back = np.searchsorted(chosen, order.view(np.uint64))
        for batch in batches:
            words = [np.asarray(w, np.int64) for w in batch.column("words").to_pylist()]
            hits = [back[np.searchsorted(order, np.intersect1d(w, order))].tolist() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(hits, pa.list_(pa.int32())), batch.column("shape")], ["domain", "places", "shape"])

    rows = found.mapInArrow(places, "domain int, places array<int>, shape array<double>").collect()
    return Classifier.fit(chosen, sorted((r.domain, np.sort(np.array(r.places, np.int64)).tolist(), list(r.shape)) for r in rows))


def _rate(posterior: Column, steps: list[list[float]]) -> Column:
    dot = lambda d: reduce(lambda s, x: s + x, (posterior[k] * F.lit(float(v)) for k, v in enumerate(d)))
    return reduce(lambda r, d: F.greatest(F.lit(0.0), r - dot(d)), steps, F.lit(1.0))


def solve(members: DataFrame, weights: dict[str, float], total: float | None = None, growth: float | None = None) -> list[list[float]]:
    """Steps to the rates of members(n_tokens, posterior). Domains without weight have target 0, and
    domains without expected tokens are left out. total: tokens wanted. None: the domain of the
    greatest weight keeps all its tokens, and the others shrink or grow to their proportion of that. growth:
    no domain is to get more than so many times its tokens, so that with 1 none is repeated; one that would
    need more stays below its weight. Warns
    where no rates meet the targets, as when a domain has no text of its own; the rates are then those of
    the steps so far, which bring the sum of squares down."""
    k = len(DOMAINS)
    steps: list[list[float]] = []
    p = F.col("posterior")
    target = None
    while True:
        rate = _rate(p, steps)
        mass = F.col("n_tokens") * F.when(F.col("rate") > 0, 1.0).otherwise(0.0)
        sums = [F.sum(F.col("rate") * F.col("n_tokens") * p[i]).alias(f"s{i}") for i in range(k)]
        sums += [F.sum(mass * p[i] * p[j]).alias(f"m{i}{j}") for i in range(k) for j in range(i, k)]
        got = members.withColumn("rate", rate).agg(*sums).first()
        now = np.array([got[f"s{i}"] or 0.0 for i in range(k)])
        m = np.array([[got[f"m{min(i, j)}{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        if target is None:
            share = np.array([weights.get(d, 0.0) for d in DOMAINS]) * (now > 0)
            if not share.sum():
                return steps
            share = share / share.sum()
            first = int(share.argmax())
            target = share * (total if total is not None else now[first] / share[first])
            if growth is not None and (short := target > growth * now * (1 + TOLERANCE)).any():
                warnings.warn(f"mixing: {[d for d, x in zip(DOMAINS, short) if x]} would have to grow over {growth} times", stacklevel=2)
                target = np.minimum(target, growth * now)
        missed = float(np.abs(now - target).max())
        if missed <= TOLERANCE * max(target.sum(), 1.0):
            return steps
        if len(steps) >= STEPS:
            warnings.warn(f"mixing: a target is missed by {missed:.0f} of {target.sum():.0f} tokens after {STEPS} steps", stacklevel=2)
            return steps
        ridge = 1e-9 * max(np.trace(m), 1e-9) * np.eye(k)
        steps.append(np.linalg.lstsq(m + ridge, now - target, rcond=None)[0].tolist())


def _members(docs: DataFrame, model: Classifier) -> DataFrame:
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                counts, p = model.posteriors(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), list_array(p.reshape(-1), np.arange(len(counts) + 1) * p.shape[1], pa.float64())], ["doc_id", "n_tokens", "posterior"])

    return stored(docs.select("doc_id", "text").mapInArrow(members, "doc_id long, n_tokens long, posterior array<double>"), "members")


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None, growth: float | None = None) -> DataFrame:
    """doc_id, n_tokens (words), posterior (of DOMAINS), rate of every row of docs(doc_id, text).

    Null and empty texts have no tokens and move no total; their rate is 1.
    Rows without doc_id or with one that repeats are rated each. Empty tables give an empty result;
    without usable labels all posteriors are equal. Other columns are ignored.
    """
    members = _members(docs, fit_classifier(docs, labels))
    rate = _rate(F.col("posterior"), solve(members, weights, total, growth))
    return members.withColumn("rate", F.when(F.col("n_tokens") == 0, 1.0).otherwise(rate))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None, growth: float | None = None, seed: int = 11) -> DataFrame:
    """The rows of docs, all columns, each as often as its rate says: the whole part of the rate, and once
    more if a hash of its id and text falls below the rest. Without shuffle of the texts."""
    model = fit_classifier(docs, labels)
    steps = solve(_members(docs, model), weights, total, growth)
    name = "rate"
    while name in docs.columns:
        name += "_"

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                counts, p = model.posteriors(part.column("text"))
                rate = np.ones(len(p))
                for d in steps:
                    rate = np.maximum(0.0, rate - p @ np.array(d))
                rate[counts == 0] = 1.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rate)], [*part.schema.names, name])

    rows = docs.mapInArrow(rated, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor(F.col(name) + 1e-6) + (chance < F.col(name) + 1e-6 - F.floor(F.col(name) + 1e-6)).cast("int")).cast("int")
    return rows.withColumn(name, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
