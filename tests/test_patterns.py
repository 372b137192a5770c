import re

import pytest
from pyspark.sql import functions as F

from alertlake.functions import text as tx
from alertlake.functions.patterns import PatternError, compile_pattern, glob_to_java, matches_globs


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("r")).first()[0]


@pytest.mark.parametrize(
    "source, text, found",
    [
        (r"\bWARN\b", "警告WARN失败", True),
        (r"\bWARN\b", "WARNING", False),
        (r"\bWARN\b", "_WARN", False),
        (r"(?i)\b(warn|error)\b", "an Error.", True),
        (r"(?i)\b(warn|error)\b", "errors", False),
        (r"a\Bb", "ab", True),
        (r"end$", "end\n", False),
        (r"(?m)^b$", "a\nb\nc", True),
        (r"a.c", "a\nc", False),
        (r"a.c", "a\rc", True),
        (r"a\sb", "a\x0bb", False),
        (r"a\sb", "a\tb", True),
        (r"(?P<x>\d+)z", "12z", True),
        (r"[[:digit:]]+x", "1x", True),
        (r"[\s,]+;", ", ;", True),
        (r"[a&&b]", "&", True),
        (r"x?\by", " y", True),
    ],
)
def test_re2_meaning(spark, source, text, found):
    assert one(spark, text, compile_pattern(source).matches(F.col("t"))) is found


@pytest.mark.parametrize("source", ["(", "[a", "(?U)a"])
def test_invalid_patterns_are_refused(spark, source):
    with pytest.raises(PatternError):
        compile_pattern(source)


@pytest.mark.parametrize(
    "name, globs, matched",
    [
        ("app-api-1", ["app-*"], True),
        ("gateway", ["gateway"], True),
        ("db-1", ["app-*", "worker-*"], False),
        ("a/b", ["*"], False),
        ("a/b", ["a/?"], True),
        ("web-3", ["web-[0-2]"], False),
        ("web-3", ["web-[^0-2]"], True),
        ("a*b", [r"a\*b"], True),
        ("x", ["", "[x"], False),
        ("a]", ["a[]]"], False),
        ("a.b", ["a?b"], True),
        ("axb", ["a.b"], False),
    ],
)
def test_globs(spark, name, globs, matched):
    assert one(spark, name, matches_globs(F.col("t"), globs)) is matched


def test_malformed_globs():
    assert [glob_to_java(g) for g in ("[", "[a", "[]a]", "a\\", "[a-]")] == [None] * 5
    assert re.fullmatch("[^/]*", "abc")


def test_first_group(spark):
    patterns = [compile_pattern(r"level=(\s*)(\w+)"), compile_pattern(r"warn\w*")]
    assert one(spark, "x level= error", tx.first_group(F.col("t"), patterns)) == "ERROR"
    assert one(spark, "a warning", tx.first_group(F.col("t"), patterns)) == "WARNING"
    assert one(spark, "nothing", tx.first_group(F.col("t"), patterns)) is None


def test_trim_and_bytes(spark):
    assert one(spark, "\u3000 a\u00a0b \x85\n", tx.trim_space(F.col("t"))) == "a\u00a0b"
    assert one(spark, "日志日志", tx.byte_prefix(F.col("t"), 7)) == "日志"
    assert one(spark, "abcd", tx.byte_prefix(F.col("t"), 3)) == "abc"


@pytest.mark.parametrize("source", ["(?=a)", "a(?!b)", "(?<=a)b", "(?<!a)b", "(?>a)", r"(a)\1", "a++", "a*+", "a{2}+", "(?x)a", r"a\Z", "(?U)a"])
def test_what_re2_refuses_is_refused(spark, source):
    with pytest.raises(PatternError):
        compile_pattern(source)


@pytest.mark.parametrize(
    "source, text, found",
    [("(?i)ошибка", "ОШИБКА", True), ("(?i)échec", "Échec", True), ("(?i:é)é", "Éé", True), ("(?i:é)é", "ÉÉ", False), ("(?m:^a$)|b$", "b\nc", False), ("(?m:^a$)|b$", "c\na\nd", True), ("a{2}?b", "aab", True)],
)
def test_folding_and_line_ends(spark, source, text, found):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(compile_pattern(source).matches(F.col("t")).alias("m")).first().m is found
