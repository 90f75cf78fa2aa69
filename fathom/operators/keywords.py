"""Tagging of texts with the keywords of a dictionary: at each word the longest keyword."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that bound words unless others are given.
SPACES = " \t\n\r\x0b\x0c.,;:!?()[]{}<>\"'"


class Dictionary:
    """keyword -> value; keywords may have several words."""

    def __init__(self, words: Mapping[str, object], case: bool = False, spaces: str = SPACES) -> None:
        self.case, self.spaces = case, frozenset(spaces)
        self.trie: dict = {}
        for key, v in words.items():
            node = self.trie
            for c in key if case else key.lower():
                node = node.setdefault(c, {})
            if key:
                node[""] = (key, v)

    def search(self, text: str | None, order: str = "source") -> list[tuple[str, object, int]]:
        """(keyword, value, place) of the keywords in a text, by source, key or value."""
        if not text:
            return []
        folded = text if self.case or len(text.lower()) != len(text) else text.lower()
        out, at, size = [], 0, len(text)
        while at < size:
            if folded[at] in self.spaces or at and folded[at - 1] not in self.spaces:
                at += 1
                continue
            node, k, best = self.trie, at, None
            while k < size and (node := node.get(folded[k])) is not None:
                k += 1
                if "" in node and (k == size or folded[k] in self.spaces):
                    best = (*node[""], k)
            if best:
                out.append((best[0], best[1], at))
                at = best[2]
            else:
                at += 1
        if order == "key":
            out.sort(key=lambda x: (x[0], x[2]))
        elif order == "value":
            out.sort(key=lambda x: (str(x[1]), x[2]))
        return out


def tag(docs: DataFrame, words: Mapping[str, str], key: str = "doc_id", text: str = "text", case: bool = False, order: str = "source", spaces: str = SPACES) -> DataFrame:
    """key, pos (from 0 in the order asked for), keyword, value, at (character) of each text's keywords; no shuffle."""
    dictionary = Dictionary(words, case, spaces)
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for i, (w, v, a) in enumerate(dictionary.search(t, order)):
                    at.append(k)
                    out.append((i, w, str(v), a))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["key", "pos", "keyword", "value", "at"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(rows, f"key {kind}, pos int, keyword string, value string, at long").withColumnRenamed("key", key)
