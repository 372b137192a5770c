"""Near-duplicate documents by SetSketch bands, likelihood estimates and a check on full shingle sets.

Documents with equal shingle sets are one class. Classes that share a band are candidates. First every class is compared
with the smallest id of each of its bands (the hub). Bands whose members are then still in several components are searched whole: the
members outside the band's main component against all others, in tiles of ``TILE`` members, so that a band of any size is split
over many tasks. In both steps the sketches estimate the similarity, and pairs that reach the threshold less ``MARGIN`` are
confirmed on the full sets. Pairs inside one component need no link of their own, so a large group is never expanded into all pairs.

Defined results: a null or empty text has no shingles and is linked with nothing. A null id is returned with itself alone: no
component, kept. Repeated ids stand for one document with several texts, which are linked with each other: each row is returned, all
of them with the one component. Only the two named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.llm.frames import id_text, quoted, stored, text_bytes
from alertlake.llm.graph import components
from alertlake.llm.setsketch import REGISTERS, band_keys, band_width, compare, sketch_sets, slope
from alertlake.llm.shingles import mix, shingle_set, shingles_of, word_hashes

# The threshold of op1, and the one of all other stages that ask for near copies.
PERCENT, NEAR_PERCENT = 85, 80
# A pair is confirmed on its full sets from four standard errors of the sketch below the threshold on, or from this far below.
MARGIN = 0.1
TILE, TILE_SHINGLES = 1024, 1_000_000


def least_estimate(percent: int) -> float:
    near = percent / 100
    return near - max(MARGIN, 4 * (near * (1 - near) / REGISTERS) ** 0.5)


def fingerprint(shingles: np.ndarray) -> bytes:
    return np.array([mix(shingles).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(~shingles)), len(shingles)], np.uint64).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_shingles, print, sketch) of documents with columns doc_id and text; further columns come along."""
    further = docs.drop("doc_id", "text")
    along = further.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = text_bytes(batch), batch.column("doc_id")
            for start in range(0, len(texts), 256):
                words = [word_hashes(text) for text in texts[start : start + 256]]
                sets = [shingles_of(x) for x in words]
                rows = sketch_sets(sets)
                columns = [ids.slice(start, 256), pa.array([len(x) for x in words], pa.int64()), pa.array([len(x) for x in sets], pa.int64())]
                columns += [pa.array([fingerprint(x) if len(x) else None for x in sets], pa.binary()), pa.array([r.tobytes() if len(x) else None for r, x in zip(rows, sets, strict=True)], pa.binary())]
                columns += [batch.column(name).slice(start, 256) for name in along]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_shingles", "print", "sketch", *along])

    made = T.StructType.fromDDL("doc_id bigint, n_words bigint, n_shingles bigint, print binary, sketch binary")
    return docs.mapInArrow(run, T.StructType([*made.fields, *further.schema.fields]))


def band_rows(classes: DataFrame, percent: int) -> DataFrame:
    """(band, id, n): one row per class and band."""
    registers = band_width(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(unpack(batch.column("sketch")), registers)
            width = keys.shape[1]
            columns = [pa.array(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), width)), pa.array(np.repeat(batch.column("n").to_numpy(), width))]
            yield pa.RecordBatch.from_arrays(columns, names=["band", "id", "n"])

    return classes.mapInArrow(run, "band bigint, id bigint, n bigint")


def unpack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def sizes_fit(a: str, b: str, percent: int):
    """No pair of sets can be similar enough if their sizes differ too much."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose estimate reaches the threshold less the margin."""
    least = least_estimate(percent)
    sides = [classes.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab"]
    joined = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                na, nb = (batch.column(name).to_numpy() for name in ("na", "nb"))
                good = slope(least, *compare(unpack(batch.column("sa")), unpack(batch.column("sb"))), na / (na + nb)) >= 0
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return joined.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar enough. A pair carries one text to the other."""
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(right, "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, left = None, None
        for batch in batches:
            good = []
            for a, b in zip(text_bytes(batch, "ta"), text_bytes(batch, "tb"), strict=True):
                if a != before:
                    before, left = a, shingle_set(a)
                right_ = shingle_set(b)
                both = len(np.intersect1d(left, right_, assume_unique=True))
                good.append(100 * both >= percent * (len(left) + len(right_) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint").distinct()


def labelled(rows: DataFrame, component: DataFrame) -> DataFrame:
    named = component.select(F.col("node").alias("id"), "component")
    return rows.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))


def rest_links(bands: DataFrame, component: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components within a band that the hubs have not brought together.

    A tile compares its pairs in place, each pair in the first band that it shares, and returns no more links than join its
    components; so the rows that leave a tile do not grow with the pairs in it.
    """
    rows = labelled(bands.where("members > 2").select("band", "id", "n"), component)
    parts = rows.groupBy("band", "component").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    main = parts.groupBy("band").agg(
        F.max(F.struct("count", "n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("count").alias("count"), F.sum("n").alias("n")
    ).where("parts > 1")

    def tiles(count, n):
        return F.greatest(F.ceil(count / TILE), F.ceil(n / TILE_SHINGLES), F.lit(1))

    mixed = main.select("band", F.col("main.component").alias("main"), tiles(F.col("count"), F.col("n")).alias("columns"), tiles(F.col("count") - F.col("main.count"), F.col("n") - F.col("main.n")).alias("rows"))
    members = stored(rows.join(mixed, "band").join(classes.select("id", "sketch"), "id"), "mixed-bands").join(texts, "id")
    place = F.xxhash64("id")
    common = ["id", "n", "component", "sketch", "text"]
    asks = members.where("component <> main").select("band", F.pmod(place, "rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), *common, F.lit(True).alias("asks"))
    all_ = members.select("band", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(place, "columns").alias("j"), *common, F.lit(False).alias("asks"))
    least, registers = least_estimate(percent), band_width(percent / 100)

    def run(table: pa.Table) -> pa.Table:
        ask = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, n, label = (table.column(name).to_numpy().copy() for name in ("id", "n", "component"))
        sketch = unpack(table.column("sketch"))
        keys = band_keys(sketch, registers)
        here = int((keys[0] == table.column("band")[0].as_py()).argmax())
        sets = [shingle_set(value.as_py().encode()) for value in table.column("text")]
        other = np.flatnonzero(~ask)
        known, spelled = np.unique(np.concatenate([sets[i] for i in other]), return_inverse=True) if len(other) else (np.zeros(0, np.uint64), np.zeros(0, int))
        bounds = np.concatenate([[0], np.cumsum([len(sets[i]) for i in other])[:-1]]).astype(np.int64)
        found = []
        for k in np.flatnonzero(ask):
            fit = other[(label[other] != label[k]) & (100 * np.minimum(n[other], n[k]) >= percent * np.maximum(n[other], n[k]))]
            fit = fit[(keys[fit] == keys[k]).argmax(axis=1) == here]
            if len(fit):
                fit = fit[slope(least, *compare(sketch[k][None], sketch[fit]), n[k] / (n[k] + n[fit])) >= 0]
            if not len(fit):
                continue
            mine = np.zeros(len(known), np.int32)
            at = np.minimum(np.searchsorted(known, sets[k]), len(known) - 1)
            mine[at[known[at] == sets[k]]] = 1
            both = np.zeros(len(ids), np.int64)
            both[other] = np.add.reduceat(mine[spelled], bounds)
            for i in fit[100 * both[fit] >= percent * (n[k] + n[fit] - both[fit])]:
                if label[i] != label[k]:
                    found.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                    label[label == label[i]] = label[k]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return asks.union(all_).groupBy("band", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def same_document(rows: DataFrame) -> DataFrame:
    """(a, b): links between the classes of an id that stands for several texts."""
    spread = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a <> most")
    return rows.select("doc_id", F.col("id").alias("b")).join(spread.select("doc_id", "a"), "doc_id").where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, along: Sequence[str] = ()) -> DataFrame:
    """One row per document: the columns ``along``, which may name ``n_words``, doc_id, n_shingles, component_id, kept."""
    read = id_text(docs, id_col, text_col)
    marks = stored(sketches(docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"), *[quoted(name) for name in along if name != "n_words"])), "sketches")
    known = marks.where("doc_id IS NOT NULL AND print IS NOT NULL")
    classes = stored(known.groupBy("print").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    bands = band_rows(classes.select("id", "n", "sketch"), percent)
    hubs = bands.groupBy("band").agg(F.count("*").alias("members"), F.min(F.struct("id", "n")).alias("hub")).where("members > 1")
    shared = stored(bands.join(hubs, "band").select("band", "id", "n", "members", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "bands")
    first = shared.where("id <> hub").where(sizes_fit("n", "hub_n", percent)).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    texts = stored(read.join(shared.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id").select(F.col("doc_id").alias("id"), "text"), "texts")
    likely = stored(likely_pairs(first, classes, percent), "pairs")
    links = stored(confirmed(likely, texts, percent), "links")
    rows = marks.join(classes.select("print", "id"), "print", "left").select(*along, "doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("id"))
    component = components(links.union(rest_links(shared, components(links), classes, texts, percent)).union(same_document(rows)))
    named = labelled(rows, component).select(*along, "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
