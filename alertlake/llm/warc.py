"""WARC records and a Merkle fixity audit of replicas.

``records`` turns pages into WARC response records with their place (file, offset, length). ``fixity_tree`` hashes each
record and then, level by level, the ordered ranges of ``FANOUT`` neighbours, up to one root per file. ``audit`` compares
two trees from the roots down: a level is only read where the level above differs, so the work between replicas grows with
the damage. Every level is one grouping by a bounded key (file, range), so a file that holds a third of all records is
spread over its ranges.

Defined results: null html is an empty record body, a null url or id is written as an empty field. Files that one replica lacks,
missing and added records are reported. Equal replicas and empty tables give an empty report. Records with equal
keys are ordered by their hash; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.frames import quoted, stored

FANOUT = 16
# Records per WARC file; files are cut by count within a host.
FILE_RECORDS = 512
CRLF = "\r\n"


def record_text(url: Column, page_id: Column, html: Column) -> Column:
    """One WARC/1.0 response record; its end mark is part of it."""
    body = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"), F.coalesce(html, F.lit("")))
    head = [
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(body).cast("string"),
    ]
    return F.concat(*head, F.lit(CRLF + CRLF), body, F.lit(CRLF + CRLF))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """(warc_file, position, page_id, bytes): whole records in file order. A file holds ids of one range, about ``file_records``."""
    read = pages.select(F.col(quoted(id_col)).cast("bigint").alias("page_id"), F.col(quoted(url_col)).alias("url"), F.col(quoted(html_col)).alias("html"))
    text = record_text(F.col("url"), F.col("page_id"), F.col("html")).cast("binary")
    file_ = F.coalesce(F.floor(F.col("page_id") / file_records), F.lit(-1)).cast("bigint")
    return read.select(file_.alias("warc_file"), "page_id", text.alias("bytes"))


def leaves(rows: DataFrame) -> DataFrame:
    """(warc_file, position, offset, length, page_id, digest): each record's place in its file and its hash.

    The bytes are hashed where they are read; only digests and lengths are shuffled. A file has a bounded number of records.
    """
    small = rows.select("warc_file", "page_id", F.octet_length("bytes").cast("bigint").alias("length"), F.sha2("bytes", 256).alias("digest"))
    order = Window.partitionBy("warc_file").orderBy(F.col("page_id").asc_nulls_last(), "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return small.select("warc_file", (F.row_number().over(order) - 1).cast("bigint").alias("position"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "page_id", "digest")


def parent_level(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Hash ordered ranges of ``fanout`` neighbours. A node also carries the byte range that it covers; its place is not part
    of the hash, so that a record of another length does not spoil all ranges behind it."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "digest", "offset", "length")))
    grouped = level.groupBy("warc_file", F.floor(F.col("position") / fanout).cast("bigint").alias("parent")).agg(ordered.alias("nodes"))
    digest = F.sha2(F.concat_ws("\n", F.transform("nodes", lambda n: F.concat_ws(":", n["length"], n["digest"]))).cast("binary"), 256)
    last = F.element_at("nodes", -1)
    first = F.col("nodes")[0]
    return grouped.select("warc_file", F.col("parent").alias("position"), first["offset"].alias("offset"), (last["offset"] + last["length"] - first["offset"]).alias("length"), digest.alias("digest"))


def fixity_tree(rows: DataFrame, levels: int = 4, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the records up, each stored once; a root covers ``fanout ** (levels - 1)`` records, a whole file by default."""
    tree = [stored(leaves(rows), "fixity-0")]
    while len(tree) < levels:
        tree.append(stored(parent_level(tree[-1], fanout), f"fixity-{len(tree)}"))
    return tree


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places whose node differs or is missing on one side."""
    a = left.select("warc_file", "position", F.struct("length", "digest").alias("_left"))
    b = right.select("warc_file", "position", F.struct("length", "digest").alias("_right"))
    return a.join(b, ["warc_file", "position"], "full").where(~F.col("_left").eqNullSafe(F.col("_right"))).select("warc_file", "position")


def audit(left: list[DataFrame], right: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Damaged records: warc_file, page_id, offset, length and digest on both sides, and what is wrong."""
    suspect = differing(left[-1], right[-1])
    for a, b in zip(left[-2::-1], right[-2::-1], strict=True):
        below = suspect.select("warc_file", F.col("position").alias("_parent"))
        keys = [F.col("warc_file"), F.floor(F.col("position") / fanout).cast("bigint").alias("_parent")]

        def children(level: DataFrame) -> DataFrame:
            return level.select("*", keys[1]).join(below, ["warc_file", "_parent"], "left_semi").drop("_parent")  # noqa: B023

        last = (children(a), children(b))
        suspect = differing(*last)
    # Within the suspect ranges records are matched by id, so that a missing one does not shift its successors.
    same = Window.partitionBy("warc_file", "page_id").orderBy("position")
    sides = [
        side.select("warc_file", F.col("page_id").alias("page_id"), F.row_number().over(same).alias("copy"),
                    *[F.col(name).alias(f"{name}_{mark}") for name in ("offset", "length", "digest")])
        for side, mark in zip(last, ("left", "right"), strict=True)
    ]
    keys = [F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}")) for name in ("warc_file", "page_id", "copy")]
    both = sides[0].alias("l").join(sides[1].alias("r"), keys, "full")
    values = [f"{name}_{mark}" for mark in ("left", "right") for name in ("offset", "length", "digest")]
    named = both.select(*[F.coalesce(f"l.{name}", f"r.{name}").alias(name) for name in ("warc_file", "page_id")], *values)
    found = named.where(~F.col("digest_left").eqNullSafe(F.col("digest_right")))
    wrong = (
        F.when(F.col("digest_left").isNull(), "added")
        .when(F.col("digest_right").isNull(), "missing")
        .when(F.col("length_left") != F.col("length_right"), "resized")
        .otherwise("altered")
    )
    return found.withColumn("fault", wrong)


def read_warc(spark, path: str) -> DataFrame:
    """(warc_file, page_id, bytes) of uncompressed WARC files. The scan splits files at the version line that begins a record;
    bodies must not hold that line, which ``write_warc`` refuses."""
    mark = f"WARC/1.0{CRLF}"
    lines = spark.read.option("lineSep", mark).text(path).where("value <> ''")
    text = F.concat(F.lit(mark), F.col("value"))
    page = F.regexp_extract("value", r"WARC-Record-ID: <urn:page:(\d+)>", 1).cast("bigint")
    return lines.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("warc_file"), page.alias("page_id"), text.cast("binary").alias("bytes"))


def write_warc(rows: DataFrame, path: str) -> None:
    """Write records as uncompressed WARC files: the line end of the text sink is the end mark of a record."""
    end = CRLF + CRLF
    heads = F.regexp_count(F.col("bytes").cast("string"), F.lit("WARC/1[.]0\r\n"))
    rows = rows.where(F.when(heads == 1, True).otherwise(F.raise_error(F.lit("a body holds a WARC version line")).cast("boolean")))
    rows = rows.repartitionByRange(F.col("warc_file")).sortWithinPartitions("warc_file", F.col("page_id").asc_nulls_last())
    rows.select(F.expr(f"substring(bytes, 1, octet_length(bytes) - {len(end)})").cast("string").alias("value")).write.option("lineSep", end).text(path)
