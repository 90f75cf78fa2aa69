"""Requests that pages ask for: what a form or a link sends, and a fetch stage with the transport given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.scalar import FUNCTIONS, html_decode_text
from fathom.functions.urls import resolve
from fathom.operators import markup
from fathom.operators.interpret import inner


@dataclass(frozen=True)
class Request:
    method: str
    url: str
    body: str = ""


def form_request(page: str, base: str, number: int = 1, values: Mapping[str, str] | None = None) -> Request | None:
    """What the n-th form of a page sends when these values are filled in; None without such a form."""
    tokens = markup.tokenize(page)
    forms = [k for k, t in enumerate(tokens) if t.kind == markup.START and t.label == "form"]
    if not 1 <= number <= len(forms):
        return None
    k = forms[number - 1]
    have = markup.attributes(page[tokens[k].first : tokens[k].last])
    a, b = inner(tokens, k, page)
    fields: dict[str, str] = {}
    for t in tokens[k + 1 :]:
        if t.first >= b:
            break
        if t.kind != markup.START or t.label not in ("input", "select", "textarea"):
            continue
        own = {n: html_decode_text(v) for n, v in markup.attributes(page[t.first : t.last]).items()}
        kind = own.get("type", "text").lower()
        if "name" not in own or kind in ("submit", "button", "image", "reset", "file") or kind in ("radio", "checkbox") and "checked" not in own:
            continue
        fields[own["name"]] = own.get("value", "on" if kind in ("radio", "checkbox") else "")
    fields |= dict(values or {})
    enc = FUNCTIONS["url_encode"]
    safe = lambda s: enc(s).replace("&", "%26").replace("=", "%3D").replace("+", "%2B") if " " not in s else enc(s)
    query = "&".join(f"{safe(n)}={safe(v)}" for n, v in fields.items())
    target = resolve(have.get("action", ""), base)
    if have.get("method", "get").lower() == "post":
        return Request("POST", target, query)
    return Request("GET", target + (("&" if "?" in target else "?") + query if query else ""))


def fetch(df: DataFrame, transport: Callable[[str], str | None], url: str = "url", html: str = "html") -> DataFrame:
    """df with a column of what the transport gives for each URL; it runs on the executors, batch by batch."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{html: [None if u is None else transport(u) for u in f[url]]})

    others = [c for c in df.columns if c != html]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*others).dtypes)
    return df.select(*others).withColumn(html, F.lit(None).cast("string")).mapInPandas(rows, f"{schema}, `{html}` string")
