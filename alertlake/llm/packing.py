"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A bin never holds two documents of one source or of one duplicate cluster; ``sized`` takes the groups of near copies as
clusters. Documents are dealt by a hash of their key into
groups of about ``GROUP_ROWS`` rows; each group is packed alone, largest document first. Open bins are kept in the order
of their residual; the search begins at the first bin that is large enough and goes on to its successors until the bin
allows both the source and the cluster, which makes it the tightest compatible bin. Bins carry two bitmaps for that, one
bit per source and cluster of the group.

A text longer than a bin is cut into full bins of its own and a rest that is packed like any document, so no word is lost.

Defined results: a null or empty text is one piece of 0 words, placed like others (it also may not meet its source). A
null source or cluster conflicts with nothing. Repeated rows are packed each; ties go to the smaller key, the older bin.
An empty table gives an empty result. Only the four named columns are read, so no other column can clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm import minhash_dedup
from alertlake.llm.frames import quoted, stored

CAPACITY = 2048
GROUP_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"

Piece = tuple[int, object, object]  # size, source, cluster


def best_fit(pieces: Sequence[Piece], capacity: int) -> list[int]:
    """Bin of each piece, in the given order. Pieces must come largest first for a good fill."""
    source_bits: dict[object, int] = {}
    cluster_bits: dict[object, int] = {}
    sources: list[int] = []
    clusters: list[int] = []
    residuals: list[int] = []
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    chosen: list[int] = []
    for size, source, cluster in pieces:
        mine = 0 if source is None else 1 << source_bits.setdefault(source, len(source_bits))
        kin = 0 if cluster is None else 1 << cluster_bits.setdefault(cluster, len(cluster_bits))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & mine or clusters[order[at][1]] & kin):
            at += 1
        if at < len(order):
            residual, bin_ = order.pop(at)
        else:
            bin_ = len(residuals)
            residual = capacity
            sources.append(0)
            clusters.append(0)
            residuals.append(capacity)
        sources[bin_] |= mine
        clusters[bin_] |= kin
        residuals[bin_] = residual - size
        if residual > size:
            insort(order, (residual - size, bin_))
        chosen.append(bin_)
    return chosen


def word_count(text: Column) -> Column:
    """Maximal runs of bytes other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def copy_cluster(text: Column) -> Column:
    """Duplicate cluster by text: equal after folding ASCII case and white space."""
    folded = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(F.trim(folded), 256)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, source, cluster): near copies share a cluster, and so do texts without a word; a null text has none.

    Rows without an id are compared too, each under a number of its own. The words are counted where the texts are sketched.
    """
    text = F.col(quoted(text_col)).cast("string")
    read = docs.select(F.col(quoted(id_col)).cast("bigint").alias("pack_id"), text.alias("text"), F.col(quoted(source_col)).cast("string").alias("source"), text.isNotNull().alias("written"))
    nameless = stored(read.where("pack_id IS NULL").withColumn("near_id", F.lit(2**63 - 1) - F.monotonically_increasing_id()), "nameless")
    named = read.where("pack_id IS NOT NULL").withColumn("near_id", F.col("pack_id")).union(nameless)
    near = minhash_dedup.near_duplicates(named, "near_id", percent=minhash_dedup.NEAR_PERCENT, along=["pack_id", "n_words", "source", "written"])
    # Texts without a word are equal once white space is folded.
    blank = F.when(F.col("written"), copy_cluster(F.lit("")))
    cluster = F.when(F.col("n_words") > 0, F.col("component_id").cast("string")).otherwise(blank)
    return stored(near.select(F.col("pack_id").alias("doc_id"), "n_words", "source", cluster.alias("cluster")), "sized")


def pack(
    docs: DataFrame, id_col: str = "doc_id", size_col: str = "n_words", source_col: str = "source", cluster_col: str = "cluster",
    capacity: int = CAPACITY, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: doc_id, piece, n_words, bin_group, bin, source, cluster. (bin_group, bin) names a bin."""
    names = [(id_col, "doc_id", "bigint"), (size_col, "n_words", "bigint"), (source_col, "source", "string"), (cluster_col, "cluster", "string")]
    rows = docs.select(*[F.col(quoted(old)).cast(kind).alias(new) for old, new, kind in names])
    groups = max(1, -(-rows.count() // group_rows))
    # Rows without an id are spread by their number in the task; rows of one id hash alike.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))
    dealt = rows.withColumn("n_words", F.coalesce("n_words", F.lit(0))).withColumn("bin_group", F.pmod(spread, F.lit(groups)))
    schema = "doc_id bigint, piece bigint, n_words bigint, bin_group bigint, bin bigint, source string, cluster string"

    def run(table: pa.Table) -> pa.Table:
        rows_ = list(zip(*[table.column(name).to_pylist() for name in ("doc_id", "n_words", "source", "cluster")], strict=True))
        rows_.sort(key=lambda row: (row[0] is None, row[0] or 0, row[1], row[2] or "", row[3] or ""))
        pieces = []
        for doc_id, words, source, cluster in rows_:
            whole, rest = divmod(words, capacity)
            sizes = [capacity] * whole + ([rest] if rest or not whole else [])
            pieces += [(size, k, doc_id, source, cluster) for k, size in enumerate(sizes)]
        pieces.sort(key=lambda piece: -piece[0])
        bins = best_fit([(size, source, cluster) for size, _, _, source, cluster in pieces], capacity)
        group = table.column("bin_group")[0].as_py()
        made = [(doc, k, size, group, bin_, source, cluster) for (size, k, doc, source, cluster), bin_ in zip(pieces, bins, strict=True)]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names_ = ["doc_id", "piece", "n_words", "bin_group", "bin", "source", "cluster"]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names_)

    return dealt.groupBy("bin_group").applyInArrow(run, schema)


