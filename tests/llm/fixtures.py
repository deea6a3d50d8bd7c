"""Small tables with what the operators must cope with."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, key string, _base string, size double"


def documents(spark, texts, sources=None):
    """Documents 0, 1, .. with extra columns whose names operators use themselves."""
    sources = sources or ["s"] * len(texts)
    rows = [(i, t, "en", s, len(t or ""), 1, "k", "b", 2.0) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def odd_documents(spark):
    """Nulls in every column, empty and white texts, ties, repeated rows and ids, a long text."""
    long = "word " * 30_000 + "x" * 5_000
    rows = [
        (None, None, None, None, None, None, None, None, None),
        (None, "null id", "en", "s", 7, 1, "k", "b", 2.0),
        (1, "", "en", "s", 0, 1, "k", "b", 2.0),
        (2, " \n\t ", "en", None, 4, 1, "k", "b", 2.0),
        (3, "Same text here", "en", "s", 14, 1, "k", "b", 2.0),
        (3, "Same text here", "en", "s", 14, 1, "k", "b", 2.0),
        (3, "other text of the same id", "en", "t", 25, 1, "k", "b", 2.0),
        (4, "Same text here", "en", "t", 14, 1, "k", "b", 2.0),
        (5, long, "en", "t", len(long), 1, "k", "b", 2.0),
        (6, "Ünïcödé \U0001f600 日本 é", None, "s", 14, 1, "k", "b", 2.0),
    ]
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (0, base, 1),
        (1, base, None),
        (1, base, None),
        (2, [1.0, 2.0, 3.0, 4.001], 2),
        (3, [-1.0, 0.0, 0.0, 0.5], 2),
        (4, None, 1),
        (5, [0.0, 0.0, 0.0, 0.0], 1),
        (6, [1.0, None, 3.0, 4.0], 1),
        (7, [1.0, nan, 3.0, 4.0], 1),
        (8, [1.0, inf, 3.0, 4.0], 1),
        (9, [], 1),
        (10, [1.0, 2.0], 1),
        (None, base, 1),
        (100, [2.0, 4.0, 6.0, 8.0], 1),
    ]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
