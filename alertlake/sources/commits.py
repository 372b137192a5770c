"""Whole commits of stored batches, and merging the files of many commits into few.

A commit is noted in the folder ``_commits`` beside the batches once all of its files are written; readers pass over files
of commits without a note. Merging writes the batches of all commits up to a number once more, as one commit, and then notes that it
stands for them: this one note shows the merged files and hides the others, which are deleted after it. A run that ends
anywhere in between is repeated as a whole and changes nothing that readers see.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Merged commits are numbered from here on, above all others.
MERGED = 1 << 50
NOTES = "_commits"


def commit_place(commit: int) -> int:
    """Place of a commit in time: the end of a job after commit n, numbered -2 - n, stands between n and n + 1."""
    return 2 * commit if commit >= 0 else 2 * (-2 - commit) + 1


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files, folder = _path(spark, path)
    return [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []


def note_commit(spark: SparkSession, path: str, name: str) -> None:
    files, note = _path(spark, f"{path.rstrip('/')}/{NOTES}/{name}")
    files.create(note, True).close()


def merged_up_to(names: list[str]) -> int | None:
    return max((int(name[7:]) for name in names if re.fullmatch(r"merged=\d+", name)), default=None)


def noted_commits(names: list[str]) -> list[int]:
    return [int(name[7:]) for name in names if re.fullmatch(r"commit=-?\d+", name)]


def visible_commits(spark: SparkSession, path: str) -> list[int] | None:
    """Commits that are whole and not merged into another; None where commits are not noted."""
    names = names_in(spark, f"{path.rstrip('/')}/{NOTES}")
    upto = merged_up_to(names)
    whole = [commit for commit in noted_commits(names) if commit >= MERGED or upto is None or commit_place(commit) > 2 * upto + 1]
    alone = [commit for commit in whole if commit < MERGED] + ([] if upto is None else [MERGED + upto])
    return alone if names else None


def commit_of(file: Column) -> Column:
    """Number of the commit that a file belongs to, NULL for files of no commit."""
    return F.regexp_extract(file, r"/commit=(-?\d+)/", 1).try_cast("bigint")


def whole_commits(stored: DataFrame, path: str) -> DataFrame:
    """Rows, with their ``file``, of visible commits and of no numbered commit at all."""
    shown = visible_commits(stored.sparkSession, path)
    if shown is None:
        return stored
    numbers = stored.sparkSession.createDataFrame([(commit,) for commit in [*shown, -1]], "_shown bigint")
    marked = stored.withColumn("_commit", F.coalesce(commit_of(F.col("file")), F.lit(-1)))
    return marked.join(numbers, F.col("_commit") == F.col("_shown"), "left_semi").drop("_commit")


def drop_hidden(spark: SparkSession, path: str, upto: int) -> int:
    """Delete the folders and then the notes of what has been merged up to a commit; returns the number of folders."""
    def hidden(commit: int) -> bool:
        return MERGED <= commit < MERGED + upto or (commit < MERGED and commit != -1 and commit_place(commit) <= 2 * upto + 1)

    files, root = _path(spark, path)
    dropped = 0
    for status in files.globStatus(_path(spark, f"{path.rstrip('/')}/month=*/day=*/kind=*/commit=*")[1]) or []:
        if hidden(int(status.getPath().getName()[7:])):
            dropped += files.delete(status.getPath(), True)
    for name in names_in(spark, f"{path.rstrip('/')}/{NOTES}"):
        number = int(name.split("=")[1])
        if (name.startswith("commit=") and hidden(number)) or (name.startswith("merged=") and number < upto):
            files.delete(_path(spark, f"{path.rstrip('/')}/{NOTES}/{name}")[1], True)
    return dropped
