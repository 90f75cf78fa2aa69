"""Soft-membership mixing: a classifier fitted on the labels says which domains a text belongs to, and
projected gradients find document rates whose expected tokens by domain meet the targets."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import BATCH_ROWS, HASH_BITS, at_most, by_rows, fresh, md5_60, tidied, tidy, written

#: Labelled rows that the classifier is fitted on, at most: those with the smallest hash of the key.
FIT_ROWS = 10_000

#: Counted features: words by hash, and bytes.
WORD_BUCKETS = 2048
FEATURES = WORD_BUCKETS + 256 + 3

#: Steps of the classifier's fit, and its pull of weights (of features in units of their spread) to 0.
STEPS, PULL = 200, np.float32(2e-3)

#: Rounds of projected gradients, at most, and the change of the misses (in shares of a domain's tokens) at which they end.
ROUNDS, SETTLED = 60, 1e-5

#: Miss of a target, in its own share, that is logged as a warning.
FAR_OFF = 0.01

log = logging.getLogger(__name__)

#: Words whose bucket a worker remembers; the table is emptied when full, which costs time only.
KNOWN_WORDS = 100_000


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        b = self[word] = xxhash.xxh3_64_intdigest(word.lower()) % WORD_BUCKETS
        return b


_BUCKETS = Buckets()


def features(text: bytes | None) -> tuple[int, np.ndarray]:
    """Tokens (words between ASCII white space) of a text, and its features: none depends on the key or other columns."""
    x = np.zeros(FEATURES, np.float32)
    x[-1] = 1
    words = text.split() if text else []
    if words:
        at = np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words))
        x[:WORD_BUCKETS] = np.sqrt(np.bincount(at, minlength=WORD_BUCKETS) / len(at))
        x[WORD_BUCKETS : WORD_BUCKETS + 256] = np.sqrt(np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text))
        x[-3] = np.mean(at[1:] == at[:-1]) if len(at) > 1 else 0
        x[-2] = np.log1p(len(at)) / 10
    return len(words), x


@dataclass
class Classifier:
    """Softmax regression; weights is [features, domains], a domain without labels has the share 0."""

    weights: np.ndarray
    known: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.where(self.known, x @ self.weights, -np.inf) if self.known.any() else np.zeros((len(x), len(self.known)))
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _curvature(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x / rows, by power iteration, with some room."""
    v = np.ones(x.shape[1], np.float32)
    size = 1.0
    for _ in range(30):
        v = x.T @ (x @ v) / len(x)
        size = float(np.linalg.norm(v))
        v /= size or 1.0
    return 1.05 * size + 1e-6


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: dict[str, str], key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Classifier:
    """domains: name to an SQL condition over labels; the first that holds is a row's domain.

    Labels without a key or a domain teach nothing; of a key's labels the first domain counts, of its
    rows the smallest text. At most ``rows`` labels are taken, those with the smallest hashes, so they
    may be broadcast, and the driver gets no more than as many feature vectors.
    """
    domain = F.coalesce(*[F.when(F.expr(c), k) for k, c in enumerate(domains.values())])
    known = labels.select(F.col(key), domain.alias("domain")).where(F.col(key).isNotNull() & F.col("domain").isNotNull()).groupBy(key).agg(F.min("domain").alias("domain"))
    some = at_most(written(known, "domain-labels"), key, rows)
    train = docs.select(F.col(key), F.col(text).cast("binary").alias("text")).join(F.broadcast(some), key).groupBy(key).agg(F.min("text").alias("text"), F.first("domain").alias("domain")).select("text", "domain")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_rows(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([features(t)[1].astype(np.float16).tobytes() for t in b.column(0).to_pylist()], pa.binary())], ["domain", "x"])

    seen = written(train.mapInArrow(tidied(vectors), "domain int, x binary"), "domain-vectors")
    y, x = np.empty(n := seen.count(), np.int64), np.empty((n, FEATURES), np.float32)
    for k, r in enumerate(seen.toLocalIterator()):  # by partitions, so the driver holds the vectors once
        y[k], x[k] = r.domain, np.frombuffer(r.x, np.float16)
    counts = np.bincount(y, minlength=len(domains))
    weights = np.zeros((FEATURES, len(domains)))
    if len(y):
        truth = np.eye(len(domains), dtype=np.float32)[y]
        deviation = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / n - x.mean(0) ** 2, 0))  # without a copy of x
        spread = deviation + 0.02 * deviation.max()
        spread[-1] = 1
        x /= spread  # in place: x is the one large array here
        mask, look = np.where(counts > 0, 0.0, -np.inf).astype(np.float32), weights.astype(np.float32)
        old, step = look.copy(), np.float32(2 / _curvature(x))
        for k in range(STEPS):  # accelerated gradients
            z = np.exp(np.maximum((s := x @ look + mask) - s.max(1, keepdims=True), -60)) * (counts > 0)
            p = z / z.sum(1, keepdims=True)
            new = look - step * (x.T @ (p - truth) / len(y) + PULL * look)
            look, old = new + np.float32(k / (k + 3)) * (new - old), new
        weights = old / spread[:, None]
    return Classifier(weights, counts > 0)


def posteriors(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, tokens, posterior (one share for each domain); no shuffle."""
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_rows(batches):
            found = [features(t) for t in b.column(1).to_pylist()]
            p = model.posteriors(np.stack([x for _, x in found])) if found else np.zeros((0, len(model.known)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["key", "tokens", "posterior"])
        tidy()

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return slim.mapInArrow(rows, f"key {kind}, tokens long, posterior array<double>").withColumnRenamed("key", key)


@dataclass
class Rates:
    """The rule that gives a document its rate: projected gradients replayed from the misses of each round.

    have, target and reached: expected tokens by domain at rate 1, as asked for, and as the rates give them.
    """

    have: np.ndarray
    target: np.ndarray
    ridge: float = 0.0
    low: float = 0.0
    high: float = math.inf
    misses: list[np.ndarray] = field(default_factory=list)
    pushes: list[float] = field(default_factory=list)  # how far each round looks ahead
    reached: np.ndarray | None = None

    def run(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p: [documents, domains]. The rates, and where the next round's misses are taken.
        Each round's miss by domain is all that documents share."""
        rate = look = np.clip(np.ones(len(p)), self.low, self.high)
        for miss, push in zip(self.misses, self.pushes, strict=True):
            new = np.clip(look - (p @ miss + self.ridge * (look - 1)) / (1 + self.ridge), self.low, self.high)
            look, rate = new + push * (new - rate), new
        return rate, look

    def of(self, p: np.ndarray) -> np.ndarray:
        return self.run(p)[0]

    def ahead(self, p: np.ndarray) -> np.ndarray:
        return self.run(p)[1]

    def report(self, domains: Sequence[str]) -> str:
        return "; ".join(f"{d}: {h:.0f} tokens, target {t:.0f}, reached {r:.0f}" for d, h, t, r in zip(domains, self.have, self.target, self.reached, strict=True))


def _totals(members: DataFrame, weigh: Callable[[np.ndarray], np.ndarray], domains: int) -> np.ndarray:
    """Sum over documents of weigh(p) * tokens * p, a number for each domain: one small row a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(domains)
        for b in batches:
            p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)
            total += (weigh(p) * b.column(0).to_numpy(zero_copy_only=False)) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"d{k}" for k in range(domains)])

    out = members.select("tokens", "posterior").mapInArrow(rows, ", ".join(f"d{k} double" for k in range(domains)))
    return np.array([x or 0.0 for x in out.agg(*[F.sum(c).alias(c) for c in out.columns]).first()], float)


def fit_rates(members: DataFrame, weights: Sequence[float], low: float = 0.0, high: float = math.inf, keep_all: bool = False, ridge: float = 0.0, rounds: int = ROUNDS) -> Rates:
    """Nonnegative rates (in [low, high]) for a table of posteriors.

    The targets are ``weights`` (by domain; those without any token are shared out over the others)
    of all tokens. keep_all raises the total until no domain needs a mean rate under 1. Minimised is
    the squared miss of the targets, each in shares of what its domain has, so that a rare domain's
    counts as much as a common one's and a step of 1 is right whatever the shares; rates start at 1,
    and ``ridge`` pulls them back there. Every round is one distributed sum of as many numbers as there
    are domains; momentum starts anew when the misses grow. What limits leave unmet is in ``reached``.
    """
    k = len(weights)
    have = _totals(members, lambda p: np.ones(len(p)), k)
    total = have.sum()
    if not total:
        return Rates(have, have, ridge, low, high, reached=have)
    there = have > 1e-9 * total
    share = np.where(there, np.asarray(weights, float), 0.0)
    share = share / share.sum() if share.sum() else have / total
    target = share * (max((have / total)[share > 0] / share[share > 0]) if keep_all else 1.0) * total
    rule, steps, before = Rates(have, target, ridge, low, high), 0, math.inf
    for _ in range(rounds):
        now = replace(rule, misses=list(rule.misses), pushes=list(rule.pushes))
        miss = np.where(there, (_totals(members, now.ahead, k) - target) / np.where(there, have, 1.0), 0.0)
        if rule.misses and abs(miss - rule.misses[-1]).max() < SETTLED:
            break
        off = float((miss * miss) @ have) / total
        steps = steps + 1 if off <= before else 0
        before = off
        rule.misses.append(miss)
        rule.pushes.append(steps / (steps + 3))
    rule.reached = _totals(members, rule.of, k)
    return rule


def _told(rule: Rates, domains: Sequence[str]) -> Rates:
    off = np.abs(rule.reached - rule.target) > FAR_OFF * np.maximum(rule.target, FAR_OFF * rule.target.sum())
    log.log(logging.WARNING if off.any() else logging.INFO, "mixture: %s", rule.report(domains))
    return rule


def with_rates(members: DataFrame, rule: Rates, rate: str = "rate") -> DataFrame:
    @F.pandas_udf("double")
    def of(posterior):
        import pandas as pd

        return pd.Series(rule.of(np.stack(posterior.to_numpy())) if len(posterior) else [], dtype="float64")

    return members.withColumn(rate, of("posterior"))


def copies(rate: Column, key: Column) -> Column:
    """A whole number whose mean is the rate: rounded up for the share of keys that the fraction says, by their hash."""
    draw = md5_60(F.concat(F.lit("mix#"), F.coalesce(key.cast("string"), F.lit("null")))) / F.lit(float(1 << HASH_BITS))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, domains: dict[str, str], weights: Sequence[float], key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Per row: key, tokens, posterior, rate, copies (how often the mixture takes the document).

    Null and empty texts have no tokens and the posterior of the classifier for them; without any
    usable label, all domains are equally likely. Repeated rows are documents each. An empty table
    gives an empty one. Of docs only key and text are read. What each domain had, should have and has
    got is logged, as a warning where a limit leaves a target unmet.
    """
    members = written(posteriors(docs, fit_classifier(docs, labels, domains, key, text), key, text), "posteriors")
    rule = _told(fit_rates(members, weights, **limits), domains)
    return with_rates(members, rule).withColumn("copies", copies(F.col("rate"), F.col(key)))


def mixed_rows(docs: DataFrame, labels: DataFrame, domains: dict[str, str], weights: Sequence[float], key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The rows of docs as often as the mixture takes them, with all their columns.

    Posteriors are worked out anew from each text, so no text is moved. Null and empty texts, repeated
    rows, rows without a key (all draw alike) and empty tables are as in mix().
    """
    model = fit_classifier(docs, labels, domains, key, text)
    rule = _told(fit_rates(written(posteriors(docs, model, key, text), "posteriors"), weights, **limits), domains)
    rate, again = fresh(docs, "rate"), fresh(docs, "again")

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [np.zeros(0)]
            for k in range(0, len(texts), BATCH_ROWS):  # a slice's features at once, whatever the session's batches are
                x = np.stack([features(t)[1] for t in texts.slice(k, BATCH_ROWS).to_pylist()])
                found.append(rule.of(model.posteriors(x)))
            yield pa.array(np.concatenate(found), pa.float64())
        tidy()

    of = of.asNondeterministic()  # else the filter below would work it out a second time
    rows = docs.withColumn(rate, of(F.col(text).cast("binary"))).withColumn(again, copies(F.col(rate), F.col(key))).where(F.col(again) > 0)
    return rows.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(again)))).select(*docs.columns)
