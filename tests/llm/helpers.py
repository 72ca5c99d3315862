"""Documents with the odd cases that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = [
    "The quick brown fox jumps over the lazy dog while the cat sleeps by the warm stove and dreams of mice and milk",
    "A river runs through the old town and under seven bridges before it meets the wide and quiet sea in the west",
    "Nobody knew who had built the tower on the hill but every child had climbed its broken stairs at least once",
]


def odd(spark, extra=()):
    """Missing and empty texts, missing ids and sources, repeated rows, ties, long words, odd characters."""
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(6000))
    rows = [
        (1, PROSE[0] + "\n" + PROSE[1], "en", "a", 1), (2, PROSE[0] + "\n" + PROSE[1], "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (None, PROSE[2], "en", "b", 3),
        (None, None, None, None, None), (5, " \t\n ", "en", "b", 4), (6, PROSE[2], "en", None, 3), (6, PROSE[2], "en", None, 3), (7, long, "en", "c", 9), (8, "x" * 5000, "en", "c", 9),
        (9, "é漢字😀 naïve\u0085odd break " + PROSE[1], "fr", "c", 9), (10, PROSE[1] + " " + PROSE[1] + " " + PROSE[1], "en", "a", 9), (11, "one\n\n\none\n" + PROSE[0] + "\n\n" + PROSE[2], "en", "a", 9),
        *extra,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The same rows with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(f"own {n}") for n in ("_id", "_th", "text2", "score", "_row", "gone", "fp", "h", "shard", "component", "a.b", "label", "size")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: repr(key(r)))
