"""Near-duplicate embeddings by NN-descent.

Equal vectors are one class. Random hyperplane codes, sorted, give every class some first neighbours: cells hold about
``CELL`` classes at every size, and the number of tables grows with the number of code bits, so that a pair at the threshold misses
all common cells with a probability of ``MISS``. Then each round joins neighbours with neighbours at their common centre and
keeps the best ``K`` per class. An audit compares sampled classes with all others by brute force, more of them until ``LINKS`` true links have been
seen or ``AUDITED`` classes, and counts the links that will be counted: those in the lists, and those of saturated classes within
one component. While its recall is below ``RECALL``, another round begins with new hyperplanes; after ``ROUNDS`` the job fails.
A list whose ``K`` entries all reach the threshold is saturated: it is enlarged to the whole component of links found so
far, in tiles of ``TILE`` rows that return counts instead of pairs, so a group of any size is split over many tasks.

Defined results: null vectors, and those of length zero, with null or non-finite components or no components at all, get
0 links and themselves as component. Vectors of unequal sizes never link. Repeated ids: each row is returned, with the
links of its own vector. A row without an id counts as a vector whose id is larger than any other; the component of a group of
only such rows is null and all of them are kept. Only the two named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.frames import bounded_sample, quoted, stored
from alertlake.llm.graph import components

THRESHOLD = 0.95
K = 8
# Classes per cell of a table, the least number of tables, and the likelihood that a pair at the threshold shares no cell.
CELL, TABLES, MISS = 128, 16, 1e-5
# Rows of a block: each row is compared with its own block and those on both sides.
BLOCK = 64
DESCENTS = 3
AUDITED, LINKS, RECALL, ROUNDS = 6400, 200, 0.995, 8
# Numbers for classes without an id of their own lie above this; no id does.
UNNAMED = 2**63 - 2**53
TILE = 2048
# Members that one task joins at a centre; a centre with more of them is split by a hash.
LOCAL = 128
# A round of descent that changes a smaller share of the lists is the last.
STILL = 0.002

EDGES = "a bigint, b bigint, sim double"


def vector_rows(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(vec_id, dim, vector): scaled vectors as bytes, null where a vector cannot link; and the number format of the bytes."""
    element = df.schema[vector_col].dataType.elementType.typeName()
    kind = "<f4" if element == "float" else "<f8"
    read = df.select(F.col(quoted(id_col)).cast("bigint").alias("vec_id"), F.col(quoted(vector_col)).alias("vector"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for values in batch.column("vector"):
                whole = values.is_valid and len(values) and not values.values.null_count
                row = values.values.to_numpy(zero_copy_only=False).astype(kind) if whole else np.zeros(0, kind)
                good = len(row) and np.isfinite(row).all() and row.any()
                out.append(row.tobytes() if good else None)
                dims.append(len(row) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "vector"])

    return read.mapInArrow(scale, "vec_id bigint, dim int, vector binary"), kind


class Space:
    """Vectors of one size: decoding and the steps of the search."""

    def __init__(self, dim: int, kind: str, threshold: float):
        self.dim, self.kind, self.threshold = dim, kind, threshold

    def unit(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        rows = np.frombuffer(b"".join(column.to_pylist()), self.kind).astype(np.float64).reshape(-1, self.dim)
        rows /= np.abs(rows).max(axis=1, keepdims=True, initial=1e-300)
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def tables(self, count: int) -> tuple[int, int]:
        """Bits of a code and number of tables for so many vectors."""
        bits = min(60, max(1, round(math.log2(max(count, 2) / CELL))))
        shared = (1 - math.acos(min(1.0, max(-1.0, self.threshold))) / math.pi) ** bits
        return bits, max(TABLES, math.ceil(math.log(MISS) / math.log(1 - shared)) if shared < 1 else 1)

    def first_neighbours(self, vectors: DataFrame, count: int, seed: int) -> DataFrame:
        """Edges to the best of the rows near each row, when sorted by hyperplane code and one more projection."""
        unit, dim, threshold, parts = self.unit, self.dim, self.threshold, max(2, vectors.sparkSession.sparkContext.defaultParallelism)
        bits, tables = self.tables(count)

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = np.random.default_rng(seed).normal(size=(tables, bits + 1, dim))
            for batch in batches:
                rows = unit(batch.column("vector"))
                for k in range(tables):
                    along = rows @ planes[k].T
                    code = (along[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    columns = [pa.array(np.full(len(rows), k, np.int32)), pa.array(code), pa.array(along[:, bits]), batch.column("id"), batch.column("vector")]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "code", "along", "id", "vector"])

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: pa.Table | None = None
            for batch in batches:
                new = pa.Table.from_batches([batch])
                both = new if last is None else pa.concat_tables([last, new])
                last = both.slice(max(0, len(both) - 2 * BLOCK)).combine_chunks()
                if len(both) > 1:
                    yield near_in_cells(both)

        def near_in_cells(table: pa.Table) -> pa.RecordBatch:
            ids, k, code = (table.column(name).to_numpy() for name in ("id", "k", "code"))
            rows, edges = unit(table.column("vector")), []
            for start in range(0, len(ids), BLOCK):
                low, high = max(0, start - BLOCK), min(len(ids), start + 2 * BLOCK)
                mine = np.arange(start, min(len(ids), start + BLOCK))
                sims = rows[mine] @ rows[low:high].T
                sims[(k[mine][:, None] != k[low:high]) | (code[mine][:, None] != code[low:high])] = -2.0
                sims[np.arange(len(mine)), mine - low] = -2.0
                top = np.argsort(-sims, axis=1, kind="stable")[:, :K]
                value = np.take_along_axis(sims, top, 1)
                # The two nearest begin the descent; all others are only of use as links.
                i, j = np.nonzero((value >= threshold) | (value > -2.0) & (np.arange(top.shape[1]) < 2))
                edges.append((ids[mine[i]], ids[low + top[i, j]], value[i, j]))
            return edge_batch(*[np.concatenate(x) for x in zip(*edges, strict=True)])

        coded = vectors.mapInArrow(codes, "k int, code bigint, along double, id bigint, vector binary")
        order = ["k", "code", "along", "id"]
        return coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(beside, EDGES)

    def descend(self, vectors: DataFrame, lists: DataFrame) -> DataFrame:
        """Join the neighbours of every centre with each other, both ways, and keep the best of each class."""
        unit = self.unit

        def join_local(table: pa.Table) -> pa.Table:
            ids, kth = table.column("member").to_numpy(), table.column("kth").to_numpy()
            rows = unit(table.column("vector"))
            sims = rows @ rows.T
            np.fill_diagonal(sims, -2.0)
            top = np.argsort(-sims, axis=1)[:, :K]
            value = np.take_along_axis(sims, top, 1)
            i, j = np.nonzero((value > kth[:, None]) & (value > -2.0))
            return pa.Table.from_batches([edge_batch(ids[i], ids[top[i, j]], value[i, j])])

        for _ in range(DESCENTS):
            kth = lists.groupBy("a").agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(-1.5).alias("kth")).withColumnRenamed("a", "member")
            both = lists.select(F.col("a").alias("center"), F.col("b").alias("member")).union(lists.select("b", "a")).distinct()
            parts = both.groupBy("center").agg(F.ceil(F.count("*") / LOCAL).alias("parts"))
            placed = both.join(parts, "center").withColumn("part", F.pmod(F.xxhash64("member"), "parts")).drop("parts")
            members = placed.join(vectors.select(F.col("id").alias("member"), "vector"), "member").join(kth, "member", "left")
            members = members.withColumn("kth", F.coalesce("kth", F.lit(-1.5)))
            found = members.groupBy("center", "part").applyInArrow(join_local, EDGES)
            new = stored(best_lists(lists.union(found)), "lists")
            changed = new.join(lists, ["a", "b"], "left_anti").count()
            lists = new
            if changed <= STILL * new.count():
                break
        return lists

    def audit(self, vectors: DataFrame, near: DataFrame, full: DataFrame, component: DataFrame, count: int) -> float:
        """Share of the true links of sampled classes that ``search`` will count."""
        found = near.select("a", "b").union(near.select("b", "a")).distinct().withColumn("listed", F.lit(True))
        named = [component.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")) for side in ("a", "b")]
        fulls = [full.select(F.col("id").alias(side), F.lit(True).alias(f"f{side}")) for side in ("a", "b")]
        same = (F.coalesce("ca", "a") == F.coalesce("cb", "b")) & (F.col("fa").isNotNull() | F.col("fb").isNotNull())
        rows = 400
        while True:
            true = self.true_links(vectors, bounded_sample(vectors, rows, "id", count))
            for right, side in zip([*named, *fulls], "abab", strict=True):
                true = true.join(right, side, "left")
            hit = F.coalesce("listed", F.lit(False)) | same
            hits, links = true.join(found, ["a", "b"], "left").agg(F.count_if(hit), F.count("*")).first()
            if links >= LINKS or rows >= min(count, AUDITED):
                return hits / links if links else 1.0
            rows *= 4

    def true_links(self, vectors: DataFrame, sample: DataFrame) -> DataFrame:
        """All links of a few vectors, by comparison with every vector."""
        unit, threshold, taken = self.unit, self.threshold, sample.toPandas()
        ids, rows = taken["id"].to_numpy(), unit(pa.array(taken["vector"].map(bytes), pa.binary()))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, other = unit(batch.column("vector")), batch.column("id").to_numpy()
                for start in range(0, len(own), 1024):
                    sims = own[start : start + 1024] @ rows.T
                    i, j = np.nonzero(sims >= threshold)
                    a, b, sim = ids[j], other[start + i], sims[i, j]
                    yield edge_batch(a[a != b], b[a != b], sim[a != b])

        return vectors.mapInArrow(exact, EDGES)

    def enlarge(self, vectors: DataFrame, full: DataFrame, component: DataFrame) -> DataFrame:
        """(id, links): links between saturated classes and all others of their component, weighted by class size, tile by tile."""
        unit, threshold = self.unit, self.threshold
        roots = component.select("component").distinct().withColumn("node", F.col("component"))
        named = component.union(roots.select("node", "component")).distinct().withColumnRenamed("node", "id")
        members = named.join(full.withColumn("full", F.lit(True)), "id", "left").withColumn("full", F.coalesce("full", F.lit(False)))
        sizes = members.groupBy("component").agg(
            F.ceil(F.count_if("full") / TILE).alias("rows"), F.ceil(F.count("*") / TILE).alias("columns")
        ).where("rows > 0")
        both = members.join(sizes, "component").join(vectors.select("id", "mult", "vector"), "id")
        tile = F.xxhash64("id")
        left = both.where("full").select("component", F.pmod(tile, "rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), "id", "full", "mult", "vector", F.lit(True).alias("asks"))
        right = both.select("component", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(tile, "columns").alias("j"), "id", "full", "mult", "vector", F.lit(False).alias("asks"))

        def count(table: pa.Table) -> pa.Table:
            asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            ids, mult, full_ = (table.column(name).to_numpy(zero_copy_only=False) for name in ("id", "mult", "full"))
            rows = unit(table.column("vector"))
            linked = rows[asks] @ rows[~asks].T >= threshold
            linked &= ids[asks][:, None] != ids[~asks][None, :]
            plain = ~full_[~asks].astype(bool)
            links = np.concatenate([linked @ mult[~asks], mult[asks] @ linked[:, plain]])
            return pa.table({"id": pa.array(np.concatenate([ids[asks], ids[~asks][plain]])), "links": pa.array(links.astype(np.int64))})

        return left.union(right).groupBy("component", "i", "j").applyInArrow(count, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def edge_batch(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "sim"])


def best_lists(edges: DataFrame) -> DataFrame:
    """The best ``K`` neighbours of each class, from edges of either direction."""
    both = edges.union(edges.select("b", "a", "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return both.withColumn("place", place).where(F.col("place") <= K).drop("place")


def search(vectors: DataFrame, space: Space) -> tuple[DataFrame, DataFrame]:
    """(id, links), links to other classes weighted by their size, and (node, component), for the vectors of one size."""
    count = vectors.count()
    lists = None
    for attempt in itertools.count(1):
        fresh = space.first_neighbours(vectors, count, seed=16 + attempt)
        lists = stored(best_lists(fresh if lists is None else fresh.union(lists)), "lists")
        lists = space.descend(vectors, lists)
        near = lists.where(F.col("sim") >= space.threshold)
        full = near.groupBy("a").count().where(F.col("count") >= K).select(F.col("a").alias("id"))
        component = stored(components(near), "components")
        recall = space.audit(vectors, near, full, component, count)
        if recall >= RECALL:
            break
        if attempt == ROUNDS:
            raise RuntimeError(f"the search for near vectors ended with a recall of {recall:.4f}, below {RECALL}")
    mult = vectors.select(F.col("id").alias("b"), "mult")
    loose = near.select("a", "b").union(near.select("b", "a")).distinct()
    for side in ("a", "b"):
        loose = loose.join(full.withColumnRenamed("id", side), side, "left_anti")
    listed = loose.join(mult, "b").groupBy("a").agg(F.sum("mult").alias("links")).withColumnRenamed("a", "id")
    links = listed.union(space.enlarge(vectors, full, component)).groupBy("id").agg(F.sum("links").alias("links"))
    return links, component


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, kind = vector_rows(df, id_col, vector_col)
    rows = stored(rows, "vectors")
    key = F.sha2("vector", 256).alias("key")
    # A class is known by its smallest id; one without, or whose id has other vectors too, gets a number of its own.
    several = rows.where("vector IS NOT NULL").groupBy(F.col("vec_id").alias("least")).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    several = several.where("first <> last").select("least", F.lit(True).alias("several"))
    unnamed = F.lit(2**63 - 1) - F.monotonically_increasing_id()
    classes = rows.where("vector IS NOT NULL").groupBy("dim", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    classes = classes.join(several, "least", "left").withColumn("id", F.coalesce(F.when(F.col("several").isNull(), F.col("least")), unnamed))
    classes = stored(classes.select("id", "least", "dim", "mult", key, "vector"), "classes")
    # One vector size is the rule; each size is searched on its own.
    sizes = [row[0] for row in classes.select("dim").distinct().collect()]
    found = [search(classes.where(F.col("dim") == dim), Space(dim, kind, threshold)) for dim in sizes]
    if found:
        links, component = found[0]
        for more_links, more_component in found[1:]:
            links, component = links.union(more_links), component.union(more_component)
        named = classes.select("key", "id", "least", "mult").join(links, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    else:
        named = classes.select("key", "id", "least", "mult", F.lit(None).cast("bigint").alias("links"), F.lit(None).cast("bigint").alias("component"))
    named = named.withColumn("root", F.coalesce("component", "id"))
    others = named.where(F.col("id") > UNNAMED).groupBy("root").agg(F.min("least").alias("other"))
    result = rows.select("vec_id", "vector", key).join(named, "key", "left").join(others, "root", "left")
    n_links = F.coalesce(F.col("mult") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.least(F.when(F.col("root") <= UNNAMED, F.col("root")), "other"))
    named = result.select("vec_id", n_links.cast("bigint").alias("n_links"), component.alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
