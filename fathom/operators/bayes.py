"""Naive Bayes over categorical features, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Added to every count.
SMOOTHING = 0.5


def _long(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """A row for each feature and value: a value's parts between | count each, an empty one is "0"."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.split(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", "0").otherwise(F.col(f).cast("string")), r"\|").alias("values")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", F.explode("p.values").alias("value"))


@dataclass
class Model:
    """labels: label, n. counts: label, feature, value, n. Numeric features have as many values as they have; others count as two."""

    labels: DataFrame
    counts: DataFrame
    features: tuple[str, ...]
    numeric: tuple[str, ...] = ()

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """key, label, probability. Values that training didn't see are left out. The labels, a few, come to the driver; counts don't."""
        classes = {r.label: r.n for r in self.labels.orderBy("label").collect()}
        total, s = sum(classes.values()), SMOOTHING
        sizes = self.counts.groupBy("feature").agg(F.countDistinct("value").alias("size"))
        wide = self.counts.groupBy("feature", "value").agg(*[F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, c in enumerate(classes)])
        wide = wide.join(sizes, "feature").withColumn("size", F.when(F.col("feature").isin(list(self.numeric)), F.col("size")).otherwise(2) if self.numeric else F.lit(2))
        logs = wide.select("feature", "value", *[F.log((F.col(f"n{k}") + s) / (n + F.col("size") * s)).alias(f"l{k}") for k, n in enumerate(classes.values())])
        hits = _long(df, self.features, key).join(logs, ["feature", "value"])
        sums = hits.groupBy(key).agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(len(classes))])
        import math

        prior = [math.log((n + s) / (total + len(classes) * s)) for n in classes.values()]
        scored = df.select(key).join(sums, key, "left").select(key, *[(F.coalesce(F.col(f"l{k}"), F.lit(0.0)) + prior[k]).alias(f"l{k}") for k in range(len(classes))])
        cells = [F.struct(F.lit(c).alias("label"), F.col(f"l{k}").alias("log")) for k, c in enumerate(classes)]
        top = F.greatest(*[F.col(f"l{k}") for k in range(len(classes))]) if len(classes) > 1 else F.col("l0")
        norm = top + F.log(sum((F.exp(F.col(f"l{k}") - top) for k in range(len(classes))), F.lit(0.0)))
        return scored.withColumn("norm", norm).select(key, "norm", F.explode(F.array(*cells)).alias("c")).select(key, "c.label", F.exp(F.col("c.log") - F.col("norm")).alias("probability"))

    def to_xml(self) -> str:
        from fathom.functions.scalar import FUNCTIONS

        esc = FUNCTIONS["html_encode"]
        rows = [f'<label name="{esc(str(r.label))}" n="{r.n}"/>' for r in self.labels.orderBy("label").collect()]
        rows += [f'<count label="{esc(str(r.label))}" feature="{esc(r.feature)}" value="{esc(r.value)}" n="{r.n}"/>' for r in self.counts.orderBy("label", "feature", "value").collect()]
        return f'<naive_bayes features="{esc(",".join(self.features))}" numeric="{esc(",".join(self.numeric))}">{"".join(rows)}</naive_bayes>'


def from_xml(spark: SparkSession, text: str) -> Model:
    from fathom.functions.scalar import html_decode_text
    from fathom.operators.markup import START, attributes, tokenize

    rows = [(t.label, {k: html_decode_text(v) for k, v in attributes(text[t.first : t.last]).items()}) for t in tokenize(text) if t.kind == START]
    head = next(a for k, a in rows if k == "naive_bayes")
    split = lambda s: tuple(x for x in s.split(",") if x)
    labels = spark.createDataFrame([(a["name"], int(a["n"])) for k, a in rows if k == "label"], "label string, n long")
    counts = spark.createDataFrame([(a["label"], a["feature"], a["value"], int(a["n"])) for k, a in rows if k == "count"], "label string, feature string, value string, n long")
    return Model(labels, counts, split(head["features"]), split(head["numeric"]))


def fit(df: DataFrame, outcome: str, features: Sequence[str], numeric: Sequence[str] = ()) -> Model:
    """Counts of labels, and of values by label and feature. Rows without an outcome teach nothing."""
    known = df.where(F.col(outcome).isNotNull()).withColumn("label", F.col(outcome).cast("string"))
    labels = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = _long(known, features, "label").groupBy("label", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return Model(labels, counts, tuple(features), tuple(numeric))
