"""Exact removal of byte strings that an earlier document holds, by blockwise difference-cover suffix sorting.

Every string of ``LENGTH`` bytes belongs to its anchor, the gram of least hash in it, so equal strings meet under equal
anchors. Neighbouring strings with one anchor form a run. A run is found again in three steps:

1. Runs are hashed; per anchor, a run that an earlier document holds as a whole is settled by its hash, and only the first
   holder of each run goes on, if the anchor has other runs too. Batches keep their first holders before the shuffle, so a passage that a
   third of all documents share costs each batch one entry. Runs travel as packed hashes, grouped by anchor.
2. The runs that go on are sent as text to the bucket of their anchor. There ``cover_sort`` sorts their suffixes and gives
   the classes of equal strings; each string that has an earlier holder is marked in its document.
3. Marks and settled runs are joined with the documents, which drop the covered bytes.

Defined results: a null or empty text has no bytes. A null id is never compared and keeps its text. Rows with one id are one
document: they do not remove from each other, each loses what a smaller id holds. Further columns pass through
``remove_repeats``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.cover_sort import equal_classes
from alertlake.llm.frames import id_text, quoted, stored, text_bytes
from alertlake.llm.shingles import mix, powers

LENGTH = 50
# Bytes hashed at a time; a longer text is hashed in overlapping pieces.
PIECE = 1 << 18
# Bytes of text per bucket of anchors, and bytes sorted at a time.
BUCKET_BYTES, SORT_BYTES = 32 << 20, 4 << 20

_RNG = np.random.default_rng(4711)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_MASK48 = np.uint64(2**48 - 1)


class Hasher:
    """Runs of the strings of ``length`` bytes in texts."""

    def __init__(self, length: int):
        self.length, self.gram = length, length // 2 + 1
        self.up, self.down = powers(_BASE, PIECE + length + 1), powers(pow(_BASE, -1, 2**64), PIECE + length + 1)

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(values) + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def grams(self, sums: np.ndarray, width: int) -> np.ndarray:
        count = len(sums) - width
        return mix((sums[width:] - sums[:-width]) * self.down[:count])

    def piece(self, raw: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first string, end, anchor, hash) of each run; ``valid`` marks the strings that lie within one document."""
        sums = self.sums(_BYTE[raw])
        least, width, need = self.grams(sums, self.gram), 1, self.length - self.gram + 1
        while 2 * width <= need:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if need > width:
            least = np.minimum(least[: len(least) - need + width], least[need - width :])
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        whole = self.sums(self.grams(sums, self.length))
        content = mix((whole[stop] - whole[start]) * self.down[start] + (stop - start).astype(np.uint64))
        return start, stop, mix(least[start]), content

    def runs(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, start, stop, anchor, hash) arrays; short texts are hashed together, long ones piece by piece."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            # A text above PIECE is a group of its own, also after empty texts.
            while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
                size += len(texts[end])
                end += 1
            if size <= PIECE:
                yield from self.joined(texts[at:end], at)
            else:
                for start in range(0, size - self.length + 1, PIECE - self.length):
                    # Strings begin in [start, start + PIECE - length); the last of them ends within the piece.
                    part = texts[at][start : start + PIECE - 1]
                    for owner, low, high, anchor, content in self.joined([part], at):
                        yield owner, low + start, high + start, anchor, content
            at = end

    def joined(self, texts: list[bytes], first: int) -> Iterator[tuple[np.ndarray, ...]]:
        sizes = np.array([len(text) for text in texts])
        total = int(sizes.sum())
        if total < self.length:
            return
        raw = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.concatenate([[0], sizes.cumsum()])
        valid = np.ones(total - self.length + 1, dtype=bool)
        for bound in bounds[1:-1]:
            valid[max(0, bound - self.length + 1) : bound] = False
        start, stop, anchor, content = self.piece(raw, valid)
        owner = np.searchsorted(bounds, start, side="right") - 1
        yield owner + first, start - bounds[owner], stop - bounds[owner], anchor, content

    def all_runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        parts = list(self.runs(texts))
        if not parts:
            return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def run_id(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """The name of a run within its document: 48 bits of its hash and 16 of its anchor."""
    return ((content & _MASK48) << np.uint64(16) | (anchor & np.uint64(0xFFFF))).view(np.int64)


def narrow(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of 64-bit numbers."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(packed: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return np.pad(rows, ((0, 0), (0, 8 - width))).view("<u8").ravel()


def by_document(doc: np.ndarray, settled: np.ndarray, further: np.ndarray) -> pa.Table:
    """(doc_id, settled, further) rows from ids of runs with their documents; ``settled`` is the mark of each id."""
    order = np.argsort(doc, kind="stable")
    doc, mark, ids = doc[order], settled[order], further[order]
    first = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1)) if len(doc) else np.zeros(0, int)
    lists = []
    for kind in (True, False):
        counts = np.add.reduceat((mark == kind).astype(np.int64), first) if len(doc) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], counts.cumsum()]).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[mark == kind], pa.int64())))
    return pa.table({"doc_id": pa.array(doc[first], pa.int64()), "settled": lists[0], "further": lists[1]})


INFO = "doc_id bigint, settled array<bigint>, further array<bigint>"


def anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc_id, settled, further): runs that an earlier document holds whole, and runs whose text must be sorted."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(length)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            owner, _, _, anchor, content = hasher.all_runs(text_bytes(batch))
            if not len(owner):
                continue
            doc = ids[owner]
            order = np.lexsort((doc, content, anchor))
            doc, anchor, content = doc[order], anchor[order], content[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            holder = doc[new][np.cumsum(new) - 1]
            # Later holders within this batch are settled here; of the first holder one entry travels.
            late = holder != doc
            if late.any():
                done = np.unique(np.stack([doc[late], run_id(anchor[late], content[late])]), axis=1)
                yield packed(-1 - (done[0] % buckets), done[0], done[1].view(np.uint64), None)
            doc, anchor, content = doc[new], anchor[new], content[new]
            yield packed((anchor >> np.uint64(40)).astype(np.int64) % buckets, doc, content, anchor)

    def packed(bucket: np.ndarray, doc: np.ndarray, content: np.ndarray, anchor: np.ndarray | None) -> pa.RecordBatch:
        order = np.lexsort((doc, bucket))
        bucket, doc, content = bucket[order], doc[order], content[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1, append=bucket[-1] + 1))
        rows = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            ids, counts = np.unique(doc[low:high], return_counts=True)
            keys = b"" if anchor is None else narrow(anchor[order[low:high]], 5)
            values = narrow(content[low:high], 6 if anchor is not None else 8)
            rows.append((int(bucket[low]), ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), keys, values))
        kinds = [pa.int64()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "ids", "counts", "anchors", "contents"])

    def settle(table: pa.Table) -> pa.Table:
        ids, counts = (np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in (("ids", "<i8"), ("counts", "<u4")))
        doc = np.repeat(ids, counts)
        if table.column("bucket")[0].as_py() < 0:
            done = np.frombuffer(b"".join(table.column("contents").to_pylist()), "<i8")
            return by_document(doc, np.ones(len(doc), dtype=bool), done)
        anchor = widen(b"".join(table.column("anchors").to_pylist()), 5)
        ranked = np.sort(anchor)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        some = np.zeros(len(anchor), dtype=bool)
        if len(twice):
            place = np.minimum(np.searchsorted(twice, anchor), len(twice) - 1)
            some = twice[place] == anchor
        content = widen(b"".join(table.column("contents").to_pylist()), 6)[some]
        doc, anchor = doc[some], anchor[some]
        order = np.lexsort((doc, content, anchor))
        doc, anchor, content = doc[order], anchor[order], content[order]
        new_anchor, new_run = np.ones(len(doc), dtype=bool), np.ones(len(doc), dtype=bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_run[1:] = new_anchor[1:] | (content[1:] != content[:-1])
        holder = doc[new_run][np.cumsum(new_run) - 1] if len(doc) else doc
        settled = doc != holder
        # Runs of an anchor that one document alone holds, or that are all equal, need no text.
        group = np.cumsum(new_anchor) - 1
        first = np.flatnonzero(new_anchor)
        kinds = np.add.reduceat(new_run.astype(np.int64), first) if len(doc) else np.zeros(0, int)
        spread = (np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)) if len(doc) else np.zeros(0, bool)
        open_ = new_run & (kinds > 1)[group] & spread[group] if len(doc) else settled
        chosen = settled | open_
        return by_document(doc[chosen], settled[chosen], run_id(anchor[chosen], content[chosen]))

    rows = docs.mapInArrow(pack, "bucket bigint, ids binary, counts binary, anchors binary, contents binary")
    found = rows.groupBy("bucket").applyInArrow(settle, INFO)
    merged = [F.array_distinct(F.flatten(F.collect_list(name))).alias(name) for name in ("settled", "further")]
    return found.groupBy("doc_id").agg(*merged)


def sorted_marks(docs: DataFrame, info: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc_id, version, low, high): strings in [low, high) of a document that an earlier one holds, from the suffix sort."""
    joined = docs.join(info.where(F.size("further") > 0).select("doc_id", "further"), "doc_id")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(length)
        for batch in batches:
            data, wanted = text_bytes(batch), batch.column("further").to_pylist()
            ids, versions = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
            owner, start, stop, anchor, content = hasher.all_runs(data)
            names = run_id(anchor, content)
            bounds = np.searchsorted(owner, np.arange(len(data) + 1))
            chosen = np.zeros(len(owner), dtype=bool)
            for k, ids_ in enumerate(wanted):
                chosen[bounds[k] : bounds[k + 1]] = np.isin(names[bounds[k] : bounds[k + 1]], ids_)
            picked = np.flatnonzero(chosen)
            bucket = (anchor[picked] >> np.uint64(40)).astype(np.int64) % buckets
            picked = picked[np.argsort(bucket, kind="stable")]
            bucket.sort()
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets)) if len(bucket) else [0]
            rows = []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                part = picked[low:high]
                body = b"".join(data[owner[i]][start[i] : stop[i] + length - 1] for i in part)
                columns = np.stack([anchor[part].view(np.int64), ids[owner[part]], versions[owner[part]], start[part], stop[part]])
                rows.append((int(bucket[low]), columns.astype("<i8").tobytes(), body))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "runs", "body"])

    def mark(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<i8").reshape(5, -1) for x in table.column("runs").to_pylist()]
        anchor, doc, version, start, stop = np.concatenate(parts, axis=1)
        body = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8)
        sizes = stop - start + length - 1
        place = np.concatenate([[0], sizes.cumsum()[:-1]])
        order = np.argsort(anchor, kind="stable")
        # Blocks of whole anchors, about SORT_BYTES each; one large anchor is a block of its own, sorted bucket by bucket.
        filled = sizes[order].cumsum()
        block = filled // SORT_BYTES
        new = np.diff(anchor[order], prepend=anchor[order][0] - 1) != 0
        block = block[new][np.cumsum(new) - 1]
        found = []
        for k in np.unique(block):
            runs = order[block == k]
            text = np.concatenate([body[place[i] : place[i] + sizes[i]] for i in runs])
            count = stop[runs] - start[runs]
            begin = np.concatenate([[0], sizes[runs].cumsum()[:-1]])
            owner = np.repeat(np.arange(len(runs)), count)
            inside = np.arange(len(owner)) - np.repeat(count.cumsum() - count, count)
            suffixes = begin[owner] + inside
            at = np.full(len(text), -1, np.int64)
            at[suffixes] = np.arange(len(suffixes))
            for members, kind in equal_classes(text, suffixes, length):
                rows = at[members]
                docs_ = doc[runs[owner[rows]]]
                by = np.lexsort((docs_, kind))
                rows, docs_, kind = rows[by], docs_[by], kind[by]
                head = np.diff(kind, prepend=-1) != 0
                late = docs_ != docs_[head][np.cumsum(head) - 1]
                rows = rows[late]
                found.append(np.stack([docs_[late], version[runs[owner[rows]]], start[runs[owner[rows]]] + inside[rows]]))
        marks = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        marks = marks[:, np.lexsort(marks[::-1])]
        joint = np.ones(marks.shape[1], dtype=bool)
        joint[1:] = (np.diff(marks[0]) != 0) | (np.diff(marks[1]) != 0) | (np.diff(marks[2]) > 1)
        first = np.flatnonzero(joint)
        last = np.append(first[1:], marks.shape[1])[: len(first)] - 1
        return pa.table({"doc_id": marks[0][first], "version": marks[1][first], "low": marks[2][first], "high": marks[2][last] + 1})

    packed = joined.mapInArrow(texts, "bucket bigint, runs binary, body binary")
    return packed.groupBy("bucket").applyInArrow(mark, "doc_id bigint, version bigint, low bigint, high bigint")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, settled, marks): what to remove from the documents that lose bytes."""
    read = id_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    volume = read.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = max(8, -(-volume // BUCKET_BYTES))
    info = stored(anchors(read, length, buckets), "runs")
    marks = sorted_marks(read.withColumn("version", F.xxhash64("text")), info, length, buckets)
    settled = info.where(F.size("settled") > 0).select("doc_id", "settled", F.lit(None).cast("struct<version:bigint,low:bigint,high:bigint>").alias("mark"))
    both = settled.union(marks.select("doc_id", F.lit(None).cast("array<bigint>"), F.struct("version", "low", "high")))
    return both.groupBy("doc_id").agg(F.first("settled", ignorenulls=True).alias("settled"), F.collect_list("mark").alias("marks"))


def covered(hasher: Hasher, texts: list[bytes], versions: list[int], settled: list[list[int] | None], marks: list[list[dict] | None]) -> Iterator[np.ndarray]:
    """Maximal spans (low, high) of removed bytes, one array of pairs per text."""
    some = [i for i, ids in enumerate(settled) if ids]
    owner, start, stop, anchor, content = hasher.all_runs([texts[i] for i in some])
    names, bounds = run_id(anchor, content), np.searchsorted(owner, np.arange(len(some) + 1))
    where = {i: k for k, i in enumerate(some)}
    for i, text in enumerate(texts):
        spans = [(m["low"], m["high"]) for m in marks[i] or () if m["version"] == versions[i]]
        pairs = np.array(spans, np.int64).reshape(-1, 2)
        if i in where:
            low, high = bounds[where[i]], bounds[where[i] + 1]
            hit = low + np.flatnonzero(np.isin(names[low:high], settled[i]))
            pairs = np.concatenate([pairs, np.stack([start[hit], stop[hit]], axis=1)])
        if not len(pairs):
            yield pairs
            continue
        depth = np.zeros(len(text) + 1, np.int32)
        np.add.at(depth, pairs[:, 0], 1)
        np.add.at(depth, pairs[:, 1] + hasher.length - 1, -1)
        edge = np.flatnonzero(np.diff(depth.cumsum() > 0, prepend=False))
        yield edge.reshape(-1, 2)


def apply_spans(docs: DataFrame, id_col: str, text_col: str, length: int, fields: list[tuple[str, str]], result) -> DataFrame:
    """Join documents with what they lose, and add the columns that ``result`` makes of each text and its spans."""
    lost = repeats(docs, id_col, text_col, length).withColumnsRenamed({"doc_id": "_lost_id", "settled": "_lost_settled", "marks": "_lost_marks"})
    keyed = docs.withColumns({"_lost_key": F.col(quoted(id_col)).cast("bigint"), "_lost_version": F.xxhash64(F.col(quoted(text_col)).cast("string"))})
    joined = keyed.join(lost, F.col("_lost_key") == F.col("_lost_id"), "left").drop("_lost_key", "_lost_id")
    names = [name for name, _ in fields]
    kept = [name for name in docs.columns if name.lower() not in {n.lower() for n in names}]
    schema = docs.select(*map(quoted, kept)).withColumns({name: F.lit(None).cast(kind) for name, kind in fields}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(length)
        for batch in batches:
            texts = text_bytes(batch, text_col)
            lists = [batch.column(f"_lost_{name}").to_pylist() for name in ("version", "settled", "marks")]
            made = [result(text, spans) for text, spans in zip(texts, covered(hasher, texts, *lists), strict=True)]
            added = [pa.array([row[k] for row in made], schema_types[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in kept] + added, names=kept + names)

    schema_types = [{"bigint": pa.int64(), "string": pa.string()}[kind] for _, kind in fields]
    return joined.mapInArrow(run, schema)


def remaining(text: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def digest(text: bytes, spans: np.ndarray) -> tuple[int, int, int, str]:
        return len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(remaining(text, spans)).hexdigest()

    fields = [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    return apply_spans(id_text(docs, id_col, text_col), "doc_id", "text", length, fields, digest).drop("text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents, all columns, without repeated strings. A character is only removed whole; a null text stays null."""

    def cut(text: bytes, spans: np.ndarray) -> tuple[str]:
        whole = []
        for low, high in spans.tolist():
            while low < high and text[low] & 0xC0 == 0x80:
                low += 1
            while high > low and high < len(text) and text[high] & 0xC0 == 0x80:
                high -= 1
            whole.append((low, high))
        return (remaining(text, np.array(whole, np.int64).reshape(-1, 2)).decode(),)

    columns = docs.columns
    cut_rows = apply_spans(docs, id_col, text_col, length, [("_cut_text", "string")], cut)
    text = F.when(F.col(quoted(text_col)).isNotNull(), F.col("_cut_text")).alias(text_col)
    return cut_rows.select(*[text if name == text_col else F.col(quoted(name)) for name in columns])
