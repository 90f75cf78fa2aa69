"""Extended patterns and alignment over tables of texts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.patterns import Pattern, java_pattern


def search(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", sets: Mapping[str, Sequence[str]] | None = None, case: bool = True, overlap: bool = False) -> DataFrame:
    """key, pos (from 0), value of every match. Patterns that mean the same in Java, named sets of literal texts included, run there; others in Arrow batches."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    java = None if overlap else java_pattern(pattern, case, sets)
    if java is not None:
        return slim.select(F.col("key").alias(key), F.posexplode(F.regexp_extract_all("text", F.lit(java), F.lit(0))).alias("pos", "value"))
    kind = slim.schema[0].dataType.simpleString()
    compiled = Pattern(pattern, sets, case)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, out = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for i, v in enumerate(compiled.search_text(t, overlap) if t else ()):
                    at.append(k)
                    pos.append(i)
                    out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(out, pa.string())], ["key", "pos", "value"])

    return slim.mapInArrow(rows, f"key {kind}, pos int, value string").withColumnRenamed("key", key)


def search_words(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", sets: Mapping[str, Sequence[str]] | None = None, case: bool = True) -> DataFrame:
    """key, pos, start (word), words of every match over the texts' words between blanks."""
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    compiled = Pattern(pattern, sets, case)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, start, out = [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                words = t.split() if t else []
                for i, m in enumerate(compiled.matches(words)):
                    at.append(k)
                    pos.append(i)
                    start.append(m.start)
                    out.append(" ".join(words[m.start : m.end]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(start, pa.int32()), pa.array(out, pa.string())], ["key", "pos", "start", "words"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(rows, f"key {kind}, pos int, start int, words string").withColumnRenamed("key", key)


def align_pairs(pairs: DataFrame, a: str, b: str, case: bool = True) -> DataFrame:
    """pairs with the cost of aligning two of its text columns; NULL with NULL or anything is NULL."""
    from fathom.operators.alignment import align_cost

    @F.pandas_udf("double")
    def cost(x, y):
        import pandas as pd

        return pd.Series([None if p is None or q is None else align_cost(p, q, case) for p, q in zip(x, y, strict=True)], dtype="float64")

    return pairs.withColumn("cost", cost(F.col(a), F.col(b)))


def closest(docs: DataFrame, others: Mapping[object, str], key: str = "doc_id", text: str = "text", case: bool = True) -> DataFrame:
    """key, other, cost: of a list of texts (given by the caller, thus bounded) the one most alike each row's text."""
    from fathom.operators.alignment import closest as nearest

    names, texts = list(others), list(others.values())

    @F.pandas_udf("struct<other:string,cost:double>")
    def find(x):
        import pandas as pd

        found = [nearest(t, texts, case) if t is not None else None for t in x]
        return pd.DataFrame({"other": [None if f is None else str(names[f[0]]) for f in found], "cost": [None if f is None else f[1] for f in found]})

    return docs.select(key, find(F.col(text)).alias("f")).select(key, "f.other", "f.cost")
