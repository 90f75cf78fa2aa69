"""Token counts with the whole-token shortcut: pre-tokens proved to be one token count at once, only the rest is merged."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import by_rows

#: Tokens over which a document is marked.
LIMIT = 1024

#: Entries of a worker's table of merged pre-tokens; it is emptied when full, which costs time only.
MERGED_ENTRIES = 200_000

#: Where the pre-token patterns of all three libraries agree, character by character (tests check each one).
#: Texts with any other character, or with a very long run of white space, go to the tokenizers library whole.
PLAIN = "[\x00-ԯ -⁯₠-₿←-⏿─-➿、-〠ぁ-ゖァ-ヺ一-龥가-힣！-～\U0001f600-\U0001f64f]*"
LONG_SPACE = r"\s{5000}"


class Vocabulary:
    """One byte-level BPE vocabulary: file.json for the tokenizers library, file.tiktoken for its merge ranks."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        self.file = public_tokenizers.path(f"{name}.json")
        with open(self.file, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.plain = regex.compile(PLAIN).fullmatch
        self.long_space = regex.compile(LONG_SPACE).search
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    @cached_property
    def library(self):
        """The tokenizers library's own, for proofs and for texts that aren't plain; others do without its memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    @cached_property
    def counts(self) -> Counts:
        return Counts(self)

    def is_plain(self, text: str) -> bool:
        """Whether the fast ways give what the tokenizers library gives."""
        return text.isascii() and len(text) < 5000 or (self.plain(text) is not None and (len(text) < 5000 or self.long_space(text) is None))

    def ids(self, text: str):
        """uint32 array of the ids as the tokenizers library gives them, special strings included."""
        import numpy as np

        if self.is_plain(text):
            return self.merge.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    @cached_property
    def whole_tokens(self) -> list[str]:
        """The vocabulary's strings that alone are one pre-token and one token: proved by encoding each.

        The driver does so once, offline; workers are told (learnt()) and never prove anything.
        """
        texts = []
        for b in self.merge.token_byte_values():
            try:
                texts.append(b.decode())
            except UnicodeDecodeError:
                continue
        return [t for t, e in zip(texts, self.library.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1 and self.split(t) == [t]]

    def learnt(self, whole: list[str]) -> Vocabulary:
        """This vocabulary, which takes the strings as proved elsewhere."""
        self.__dict__.setdefault("whole_tokens", whole)
        return self

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside is one token, as the library's default has it."""
        if not text:
            return 0
        if not self.is_plain(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        n, count = 0, self.counts
        for part in self.cut(text) if "<|" in text else [text]:
            n += 1 if part in self.special else sum(map(count.__getitem__, self.split(part)))
        return n


class Counts(dict):
    """Tokens of a pre-token: the proved ones stay, merged ones are remembered as far as there is room."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.proved = dict.fromkeys(vocabulary.whole_tokens, 1)
        super().__init__(self.proved)

    def __missing__(self, token: str) -> int:
        if len(self) - len(self.proved) >= MERGED_ENTRIES:
            self.clear()
            self.update(self.proved)
        n = self[token] = len(self.vocabulary.merge.encode_ordinary(token))
        return n


@lru_cache(4)
def vocabulary(name: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(name)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", limit: int = LIMIT) -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes and tokens. Rows are independent, so repeats repeat; no
    shuffle. Other columns, whatever their names, are not read. The strings proved to be whole tokens
    (as many as the vocabulary has, at most) go out with the function.
    """
    whole = vocabulary(name).whole_tokens
    schema = docs.select(F.col(key).alias(key)).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(name).learnt(whole)
        for b in by_rows(batches):
            n = [own.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = slim.mapInArrow(rows, f"key {schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
