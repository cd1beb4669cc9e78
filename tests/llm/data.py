"""Small tables for the corpus tests: awkward rows, clashing extra columns."""

from __future__ import annotations

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog again", "b", "x"),
    (1, "The quick brown fox jumps over the lazy dog again", "b", "x"),
    (2, "  the QUICK\tbrown fox\njumps over the lazy dog again ", "a", None),
    (3, None, "a", "x"),
    (4, "", None, "x"),
    (5, " \t\n", "b", "x"),
    (6, "one two", "b", "x"),
    (7, "one two", "b", "x"),
    (None, "one two", "a", "x"),
    (9, "w " * 30_000, "a", "x"),
    (10, "é" * 5000 + " 日本語 mixed ÀÉ words", "a", "x"),
]
#: doc_id and text as documents have them, and columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, source string, lang string, n long, sid long, kept boolean, key string, size long, score double, component string, n_chars long"


def docs(spark, rows=None):
    rows = AWKWARD if rows is None else rows
    return spark.createDataFrame([(i, t, s, x, 7, 8, False, "key", 9, 0.5, "c", 3) for i, t, s, x in rows], SCHEMA)


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
