"""Queries on streams of documents, and changes between snapshots of a page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathom.operators.select import query

#: A query's document part keeps no state, so a stream of documents takes it as a table does.
stream_query = query


def changes(pages: DataFrame, url: str = "url", html: str = "html", forget_after: str | None = "30 days") -> DataFrame:
    """url, version, changed (characters that differ) of each new snapshot of a page, on a stream.

    The state of a URL is its last text's number and content; equal snapshots give no row. A URL that
    no batch has named for ``forget_after`` (processing time) is forgotten, and begins at version 1 if it comes again; None keeps all.
    """
    kept = None if forget_after is None else int(pd.Timedelta(forget_after).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=[url, "version", "changed"])
            return
        version, last = state.get if state.exists else (0, "")
        out = []
        for f in frames:
            for text in f[html].fillna(""):
                if version == 0 or text != last:
                    version += 1
                    out.append((key[0], version, differing(last, text)))
                    last = text
        state.update((version, last))
        if kept is not None:
            state.setTimeoutDuration(kept)
        yield pd.DataFrame(out, columns=[url, "version", "changed"])

    slim = pages.select(F.col(url).cast("string").alias(url), F.col(html).cast("string").alias(html))
    return slim.groupBy(url).applyInPandasWithState(step, f"`{url}` string, version long, changed long", "version long, html string", "append", GroupStateTimeout.NoTimeout if kept is None else GroupStateTimeout.ProcessingTimeTimeout)


def differing(a: str, b: str) -> int:
    """Characters of b outside the start and end that it shares with a."""
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    m = next((i for i, (x, y) in enumerate(zip(reversed(a[n:]), reversed(b[n:]), strict=False)) if x != y), min(len(a), len(b)) - n)
    return len(b) - n - m


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in each window of time; rows later than the watermark are left out."""
    counted = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")
