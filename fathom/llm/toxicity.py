"""Toxicity by maximum-scoring segments over token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import at_most, by_rows, small_batches, tidied, tidy, written

#: Labelled rows that the model is fitted on, at most: those with the smallest hash of doc_id.
FIT_ROWS = 40_000

#: Share of labels held out of any fitting: crc32(doc_id as text) mod 5 is 0.
FOLDS = 5

#: Pseudo-counts of the Dirichlet prior, spread over tokens as the labelled rows have them.
PRIOR = 20.0

#: Standard deviations that a token's rates must lie apart for it to be scored on its own.
SIGNIFICANT = 4.5

#: Log-odds from which a token is scored on its own: a factor of e.
LEAST_ODDS = 1.0

#: Score of every other token, at most: keeps the expected score negative, as extreme-value theory asks.
DRIFT = -0.05

#: Expected passages of a score by chance in a clean text of that length, under which a passage is reported.
PASSAGE_E = 0.05

#: Letters of a word's beginnings that are tokens too, marked by STEM: inflected forms share them.
STEMS = range(4, 9)
STEM = "*"

#: Words whose score a worker remembers; the table is emptied when full, which costs time only.
KNOWN_WORDS = 100_000

WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def tokens_of(word: str) -> list[str]:
    """The word, then its beginnings, longest first."""
    return [word, *(word[:n] + STEM for n in reversed(STEMS) if n < len(word))]


class WordScores(dict):
    """Word to score: that of the first of its tokens that has one, else 0."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        super().__init__()

    def __missing__(self, word: str) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        s = self[word] = next((self.scores[t] for t in tokens_of(word) if t in self.scores), 0.0)
        return s

    def __reduce__(self):
        return WordScores, (self.scores,)


def maximal_segments(scores: Sequence[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (Ruzzo and Tompa), in linear time: (first, end, score) in tokens.

    scores: (token index, score) of the tokens that don't score ``drift`` (< 0), by index.
    """
    left: list[float] = []  # sum before a candidate, sum up to its end, its ends
    right: list[float] = []
    ends: list[tuple[int, int]] = []
    prev: list[int] = []  # the nearest candidate before with a smaller left
    total, at = 0.0, 0
    for index, s in scores:
        total += drift * (index - at)
        at = index + 1
        if s <= 0:
            total += s
            continue
        lo, hi, first = total, total + s, index
        total = hi
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = prev[j]
            if j < 0 or right[j] >= hi:
                left.append(lo), right.append(hi), ends.append((first, index + 1)), prev.append(j)
                break
            lo, first = left[j], ends[j][0]
            del left[j:], right[j:], ends[j:], prev[j:]
    return [(a, b, hi - lo) for (a, b), lo, hi in zip(ends, left, right, strict=True)]


def log_factorials(n: int) -> np.ndarray:
    """ln of 0!, 1!, ... n!."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


@dataclass
class Model:
    """Token scores, the extreme-value parameters of their segments in clean text, and the final calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0  # lambda
    scale: float = 1e-3  # K
    slope: float = 0.0
    offset: float = -math.inf

    def __post_init__(self) -> None:
        self.known = WordScores(self.scores)

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the maximal segments in tokens."""
        tokens = words(text) if text else []
        hits = [(i, s) for i, s in enumerate(map(self.known.__getitem__, tokens)) if s]
        return len(tokens), maximal_segments(hits, self.drift) if hits else []

    def chance(self, n: int, score: float) -> float:
        """Expected segments of at least this score in n clean tokens."""
        return self.scale * max(n, 1) * math.exp(-self.rate * score)

    def evidence(self, n: int, found: Sequence[tuple[int, int, float]]) -> float:
        """-ln of the chance that clean text of n tokens has segments like the r best, for the r of all segments that is least likely."""
        if not found:
            return 0.0
        normal = self.rate * np.sort([s for *_, s in found])[::-1] - math.log(self.scale * max(n, 1))
        totals = np.cumsum(normal)
        totals = totals[np.logical_and.accumulate(totals > 0)]
        if not len(totals):
            return 0.0
        factorials = log_factorials(len(totals))
        return max(0.0, float(np.max(totals - np.arange(len(totals)) * np.log(totals) + factorials[1:] + factorials[:-1])))

    def score(self, evidence: float) -> float:
        z = self.slope * evidence + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(key: str):
    """Whether a row's label may not be learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of labelled documents that may be learnt from, as a table.

    Of a document's repeated labels the largest counts, of its repeated rows the smallest text; a text
    that several documents hold is one row. At most
    ``rows`` labels are taken, those with the smallest hashes, so they may be broadcast.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = written(usable.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "toxic-labels")
    some = at_most(known, "doc_id", rows)
    own = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    one = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return written(one.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic-texts")


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, documents with it by label; the empty token stands for all documents."""
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        a, b = zip(*counts.values(), strict=True) if counts else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["token", "clean", "toxic"])

    for b in by_rows(batches):
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for t in {"", *(t for w in set(words(text or "")) for t in tokens_of(w))}:
                counts.setdefault(t, [0, 0])[toxic] += 1
        if len(counts) > 300_000:
            yield out()
            counts.clear()
    yield out()
    counts.clear()
    tidy()


def _odds(clean: str, toxic: str, n0: int, n1: int) -> tuple[Column, Column]:
    """Log-odds with an informative Dirichlet prior, and the signed root of the likelihood ratio against equal rates."""
    y0, y1 = F.col(clean).cast("double"), F.col(toxic).cast("double")
    prior = PRIOR * (y0 + y1) / (n0 + n1)
    odds = F.log((y1 + prior) / (n1 + PRIOR)) - F.log((y0 + prior) / (n0 + PRIOR))
    part = lambda y, share: F.when(y > 0, y * F.log(y / ((y0 + y1) * share))).otherwise(0.0)
    ratio = F.greatest(2 * (part(y1, n1 / (n0 + n1)) + part(y0, n0 / (n0 + n1))), F.lit(0.0))
    return odds, F.sqrt(ratio) * F.signum(odds)


def token_scores(train: DataFrame) -> dict[str, float]:
    """Log-odds with an informative Dirichlet prior of the tokens whose log-odds are significant and large.

    First by the texts that hold a token, over all training rows. Texts that are copied with edits
    make all their words look so; thus the tokens found are counted again by the distinct contexts
    (the word with its neighbours) that they stand in. Only those that stay significant come to the
    driver, and the training rows bound them.
    """
    counts = train.mapInArrow(_token_rows, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = train.agg(F.sum(F.col("toxic")), F.sum(1 - F.col("toxic"))).first()
    n1, n0 = int(sizes[0] or 0), int(sizes[1] or 0)
    if not n1 or not n0:
        return {}
    odds, z = _odds("clean", "toxic", n0, n1)
    found = {r.token for r in counts.where("token <> ''").where((F.abs(z) >= SIGNIFICANT) & (F.abs(odds) >= LEAST_ODDS)).select("token").collect()}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hits: dict[str, list[str]] = {}
        for b in by_rows(batches):
            seen: set[tuple] = set()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = ["", *words(text or ""), ""]
                for i in range(1, len(ws) - 1):
                    own = hits.get(ws[i])
                    if own is None:
                        if len(hits) >= KNOWN_WORDS:
                            hits.clear()
                        own = hits[ws[i]] = [t for t in tokens_of(ws[i]) if t in found]
                    if own:
                        at = xxhash.xxh3_64_intdigest(" ".join(ws[i - 1 : i + 2])) >> 1
                        seen.update((t, toxic, at) for t in own)
            cols = list(zip(*seen, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["token", "toxic", "context"])

    places = train.mapInArrow(tidied(contexts), "token string, toxic int, context long").distinct()
    again = places.groupBy("token").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    odds, z = _odds("clean", "toxic", n0, n1)
    kept = again.select("token", odds.alias("s"), z.alias("z")).where((F.abs("z") >= SIGNIFICANT) & (F.abs("s") >= LEAST_ODDS))
    return {r.token: float(r.s) for r in kept.collect()}


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model from the training rows; with no toxic or no clean label it scores every text 0."""
    train = training_rows(docs, labels, rows)
    with small_batches(docs.sparkSession):
        model = Model(token_scores(train))
    if not any(s > 0 for s in model.scores.values()):
        return model

    least = min(s for s in model.scores.values() if s > 0)

    def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with segments; at the end one for each label with the sums over all its texts: tokens,
        texts without segments, segments of ``least`` or more, and how often each token score was met."""
        sums = {0: [0, 0, 0, {}], 1: [0, 0, 0, {}]}
        for b in batches:
            out = []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, found = model.segments(text)
                own = sums[toxic]
                own[0] += n
                if not found:
                    own[1] += 1
                    continue
                own[2] += sum(s >= least for *_, s in found)
                for s in map(model.known.__getitem__, words(text)):
                    if s:
                        own[3][s] = own[3].get(s, 0) + 1
                out.append((toxic, n, None, None, [s for *_, s in found], []))
            if out:
                yield batch(out)
        yield batch([(t, n, none, strong, list(met), [float(c) for c in met.values()]) for t, (n, none, strong, met) in sums.items()])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols, many = list(zip(*rows, strict=True)), pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4]), *(pa.array(c, many) for c in cols[4:])], ["toxic", "n", "none", "strong", "scores", "met"])

    seen = written(train.mapInArrow(tidied(segment_rows), "toxic int, n long, none long, strong long, scores array<double>, met array<double>"), "toxic-segments")
    sums = seen.where("none is not null").collect()  # two rows a task of the training texts
    clean = [r for r in sums if not r.toxic]
    tokens = max(1, sum(r.n for r in clean))
    met: dict[float, float] = {}
    for r in clean:
        for s, c in zip(r.scores, r.met, strict=True):
            met[s] = met.get(s, 0) + c
    shares = [((met.get(s, 0) + 0.5) / tokens, s) for s in set(model.scores.values())]
    rest = 1 - sum(p for p, _ in shares)

    def excess(rate: float) -> float:
        return sum(p * math.exp(min(rate * s, 700)) for p, s in shares) + rest * math.exp(rate * model.drift) - 1

    lo, hi = 0.0, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if excess(mid) > 0 else (mid, hi)
    model.rate = max(lo, 1e-3)
    model.scale = min(1.0, (sum(r.strong for r in clean) + 0.5) / tokens * math.exp(model.rate * least))

    def evidence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.evidence(n, [(0, 0, s) for s in scores]) for n, scores in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["toxic", "evidence"])

    rows = seen.where("none is null").select("toxic", "n", "scores").mapInArrow(tidied(evidence_rows), "toxic int, evidence double").collect()  # a number for each training text
    calibrate(model, [(r.evidence, r.toxic, 1) for r in rows] + [(0.0, r.toxic, r.none) for r in sums if r.none])
    return model


def calibrate(model: Model, rows: list[tuple[float, int, int]]) -> None:
    """Logistic regression of the label on the evidence, by Newton's method with a slight ridge. rows: evidence, label, texts."""
    x, y, n = (np.array(c, float) for c in zip(*rows, strict=True))
    unit = max(x.max(), 1e-9) / 10
    a = np.stack([np.minimum(x / unit, 3.0), np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (n * (y - p)) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    model.slope, model.offset = max(0.0, float(w[0] / unit)), float(w[1])


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", passages: bool = True) -> DataFrame:
    """Per row: key, held_out, score, predicted, evidence and the significant passages (characters, score, chance).

    Null and empty texts have no passage and the score of no evidence. Rows are independent, so
    repeats repeat; an empty table gives an empty one. Other columns are not read.
    """
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_rows(batches):
            evidence, scores, spans = [], [], []
            for t in b.column(1).to_pylist():
                n, found = model.segments(t)
                evidence.append(model.evidence(n, found))
                scores.append(model.score(evidence[-1]))
                told = [(a, z, s, c) for a, z, s in found if (c := model.chance(n, s)) <= PASSAGE_E] if passages else []
                if told:
                    at = [m.span() for m in WORD.finditer(t.lower())]
                    told = [{"start": at[a][0], "end": at[z - 1][1], "score": s, "chance": c} for a, z, s, c in told]
                spans.append(told)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(evidence, pa.float64()), pa.array(scores, pa.float64()), pa.array(spans, span)], ["key", "evidence", "score", "passages"])
        tidy()

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = slim.mapInArrow(rows, f"key {kind}, evidence double, score double, passages array<struct<start:long,end:long,score:double,chance:double>>")
    return out.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; no shuffle.

    A null or empty text has no passage, so it stays unless the model takes every text for toxic; repeated
    rows are judged each; an empty table gives an empty one.
    """

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model.score(model.evidence(*model.segments(t.as_py()))) < 0.5 for t in texts], pa.bool_())
        tidy()

    return docs.where(clean(F.col(text)))
