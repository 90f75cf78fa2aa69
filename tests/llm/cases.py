"""Small tables with everything that may go wrong: nulls, empty and long texts, ties, repeats, clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, row string, key string, rank double, norm string, sha string, rate string, again int, survives string"


def table(spark, texts, schema=DOCS):
    """documents with these (doc_id, text), and extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, "r", "k", 0.5, "n", "h", "q", 2, "v") for i, t in texts], schema)


LONG = "lorem ipsum dolor sit amet " * 4000

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away."),
    (2, "The quick brown fox jumps over the lazy dog and runs away."),
    (3, "The  quick brown fox\njumps over the lazy dog and runs away. "),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, LONG),
    (7, LONG),
    (8, LONG + "x"),
    (None, "a text without a key"),
    (10, "naïve café 日本語 <|endoftext|> \U0001f600\U0001f9d0 it's 12 o'clock\r\n x"),
    (-11, "short"),
    (12, "Short"),
]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
