"""Tables in and out: delimited text, XML, HTML; and text files as documents."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.columns import FUNCTIONS
from fathom.plans.columns import Typed


def guess_delimiter(sample: str) -> str:
    """The separator of a delimited text, from its first lines."""
    try:
        return csv.Sniffer().sniff(sample, ",;\t|:").delimiter
    except csv.Error:
        return ","


def read_delimited(spark: SparkSession, path: str, header: bool = True, delimiter: str | None = None) -> DataFrame:
    """Columns of text; without a delimiter, the first 20 lines tell it. Column<n> are the names where there is no header."""
    if delimiter is None:
        delimiter = guess_delimiter("\n".join(r.value for r in spark.read.text(path).limit(20).collect()))
    df = spark.read.csv(path, header=header, sep=delimiter, quote='"', escape='"', multiLine=True)
    return df if header else df.toDF(*[f"Column{k}" for k in range(1, len(df.columns) + 1)])


def guess_row_tag(sample: str) -> str | None:
    """The element that repeats most directly within the outermost one; the outermost itself if it holds none."""
    depth, found, root = 0, {}, None
    for close, name, alone in re.findall(r"<(/?)([A-Za-z_][\w.:-]*)(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)?(/?)>", re.sub(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>", "", sample, flags=re.S)):
        if close:
            depth -= 1
            continue
        root = root or name
        if depth == 1:
            found[name] = found.get(name, 0) + 1
        depth += not alone
    return max(found, key=found.get) if found else root


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """A column for each field; without a row tag, the first 200 lines tell it."""
    if row_tag is None:
        row_tag = guess_row_tag("\n".join(r.value for r in spark.read.text(path).limit(200).collect()))
    if row_tag is None:
        raise ValueError(f"no element in {path}")
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files as documents: url (the path) and html; no file is split."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def without_empty_rows(df: DataFrame) -> DataFrame:
    """Rows in which some column has a text."""
    return df.where(F.coalesce(*[F.when(F.col(f"`{c}`").cast("string") != "", True) for c in df.columns], F.lit(False)))


def write_delimited(df: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    df.write.csv(path, header=header, sep=delimiter, quote='"', escape='"')


def write_xml(df: DataFrame, path: str, row_tag: str = "record", root_tag: str = "records") -> None:
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def _encoded(c: str) -> Column:
    return FUNCTIONS["html_encode"](Typed(F.col(f"`{c}`").cast("string"), "text")).column


def html_rows(df: DataFrame) -> DataFrame:
    """One column, value: each row as a row of an HTML table."""
    return df.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), _encoded(c), F.lit("</td>")) for c in df.columns], F.lit("</tr>")).alias("value"))


def write_html(df: DataFrame, path: str) -> None:
    html_rows(df).write.text(path)


def xml_rows(df: DataFrame, row_tag: str = "record", names: Sequence[str] | None = None) -> DataFrame:
    """One column, value: each row as an XML element, its texts encoded."""
    names = names or df.columns
    cells = [F.concat(F.lit(f"<{n}>"), _encoded(c), F.lit(f"</{n}>")) for n, c in zip(names, df.columns, strict=True)]
    return df.select(F.concat(F.lit(f"<{row_tag}>"), *cells, F.lit(f"</{row_tag}>")).alias("value"))
