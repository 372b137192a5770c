"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import types as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 997} tail{i % 31}" for i in range(40_000))
PLAIN = "the quick brown fox jumps over the lazy dog and runs into the green wood near the old mill by the river " * 4


def awkward_docs():
    """Null and empty texts, null columns, ties, repeated rows, a very long text."""
    return [
        (1, PLAIN + "one", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n", "de", "b", 3),
        (5, LONG, "en", "a", 1), (6, PLAIN + "one", "en", "b", 1), (6, PLAIN + "one", "en", "b", 1), (None, PLAIN + "one", "en", "a", 1),
        (7, "short text", "en", "a", 1), (8, "short text", "en", "c", 1), (9, "Ünïcödé ▁ ünd 漢字 text", "de", "c", 1), (10, LONG + " end", "en", "c", 1),
    ]


def docs_frame(spark, rows=None, clash=()):
    frame = spark.createDataFrame(awkward_docs() if rows is None else rows, DOCS)
    for name in clash:
        frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


def empty(spark, ddl):
    return spark.createDataFrame([], T.StructType.fromDDL(ddl))


def rows_of(frame):
    return [tuple(row) for row in frame.collect()]
