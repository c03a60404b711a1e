"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "kept string, code string, n string, best string, row string, kind string, bin string, size string, word string, block string"


def random_texts(seed=7, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta,", "naïve", "日本語", "x1", "token=abc", "the", "of", "|", "e.g.", "😀", "don't"]
    out = []
    for _ in range(n):
        size = rng.choice([0, 1, 2, 3, 5, 12, 40])
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\t", " \n"]) for _ in range(size)))
    return out


def hard_rows():
    texts = random_texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (102, "  \n\t "), (None, "Alpha beta"), (103, "alpha BETA"), (104, "ALPHA beta")]
    rows += [(105, "the same row"), (105, "the same row"), (106, "x" * 30_000), (107, "long words " * 4_000)]
    rows += [(108, "line one here\nline one here\nother line\nline one here"), (109, "\0 odd \x1c chars \x85 and <|endoftext|> here"), (None, None)]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


def hard_documents(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


def with_clashes(df):
    """The same rows with more columns, named like those the operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c.split()[0]) for c in CLASHES.split(", ")])


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
