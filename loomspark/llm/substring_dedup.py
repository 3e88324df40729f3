"""Substring deduplication: removes bytes of long strings that an earlier document also has.

Positions are ranked twice, and leave as soon as they are settled. To keep the first ranking small,
positions are sampled: every string of ``length`` bytes has one anchor, the GRAM bytes of the least
hash inside it, so equal strings meet under equal anchors.

1. Strings that follow each other and share their anchor form a run. Runs are sorted by (anchor,
   content). Equal runs settle all their strings at once: only the smallest document keeps them.
   Runs of an anchor that only one document has are settled too: nothing is removed.
2. What is left are anchors with different runs, at the edges of repeats. Their single strings are
   sorted by the pair of ranks of their halves, which settles them.

Sorts go over 64-bit names of content, dealt by ranges of names, so no group meets in one place by
document or by text. Content that many documents share is settled in two steps: of the records a task
holds, only the one of the smallest document is sent on; the others are later than it, whatever other
tasks hold, so their strings are removed at once. Removed intervals return to their documents as merged
lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomspark.llm.textbytes import as_bytes, mix64, release_memory, slices
from loomspark.storage import bounded_batches, written

LENGTH, GRAM = 50, 20
#: Bytes of interval lists up to which they are sent to all executors; beyond, they are shuffled.
SMALL_BYTES = 64 << 20
#: Records sorted in one task, and records held before they are handed on.
RANGE_RECORDS, HELD_RECORDS = 400_000, 250_000
#: Bytes of text worked on at once; names of strings take some 150 bytes for each.
SLICE = 1 << 19

_M = 0x9E3779B97F4A7C15
_TABLES: dict[int, np.ndarray] = {}
_LAST = np.iinfo(np.int64).max


def _power_table(m: int, n: int) -> np.ndarray:
    if len(_TABLES.get(m, ())) < n:
        t = np.full(max(n, SLICE), m, np.uint64)
        t[0] = 1
        _TABLES[m] = np.multiply.accumulate(t)
    return _TABLES[m][:n]


class Names:
    """64-bit names of the strings of a batch of texts: equal content, equal name."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_M, len(data)), out=self.sums[1:])
        self.shift = _power_table(pow(_M, -1, 1 << 64), len(data) + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.shift[start] + np.asarray(length).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        return mix64((self.sums[length:] - self.sums[:-length]) * self.shift[: len(self.sums) - length] + np.uint64(length))


def runs(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor name, content name, text index, first byte, number of strings) of each run."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    names = Names(data)
    grams = names.every(gram)
    low = ((grams >> np.uint64(30)) << np.uint64(30)) | np.arange(len(grams), dtype=np.uint64)  # ties: the first
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = doc[: len(low)] == doc[length - 1 :]
    anchor = (low & np.uint64((1 << 30) - 1)).astype(np.int64)
    new = np.ones(len(low), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1 : len(low)] != doc[: len(low) - 1]) | (whole[1:] != whole[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(low)))
    head, count = head[whole[head]], count[whole[head]]
    return grams[anchor[head]], names.of(head, count + length - 1), doc[head], head - off[doc[head]], count


# --- packed records ----------------------------------------------------------------------------
_RECORD = np.dtype([("anchor", np.uint32), ("content", np.uint64), ("row", np.uint16), ("at", np.int32), ("count", np.uint8)])
_STRING = np.dtype([("content", np.uint64), ("row", np.uint16), ("at", np.int32)])
_SPAN = np.dtype([("id", np.int64), ("text", np.int64), ("at", np.int32), ("count", np.int32), ("kind", np.uint8)])


class _Dealer:
    """Collects records of up to 2^16 rows, settles copies among them, and hands the others on by range of a name."""

    def __init__(self, kind: np.dtype, ranges: int) -> None:
        self.kind, self.ranges = kind, ranges
        self.clear()

    def clear(self) -> None:
        self.names, self.records, self.ids, self.texts, self.size, self.rows = [], [], [], [], 0, 0

    def add(self, name: np.ndarray, row: np.ndarray, ids: np.ndarray, texts: np.ndarray, **fields: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.rows + len(ids) > 65_535 or self.size > HELD_RECORDS:
            yield from self.hand_on()
        record = np.empty(len(name), self.kind)
        record["row"] = row + self.rows
        for k, v in fields.items():
            record[k] = v
        self.names.append(name)
        self.records.append(record)
        self.ids.append(ids)
        self.texts.append(texts)
        self.size += len(name)
        self.rows += len(ids)

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            name, record = np.concatenate(self.names), np.concatenate(self.records)
            ids, texts = np.concatenate(self.ids), np.concatenate(self.texts)
            later = self._later(record["content"], ids[record["row"]])
            if later.any():
                done = record[later]
                count = done["count"] if "count" in self.kind.names else 1
                table = _by_bucket(_joined(_spans(ids[done["row"]], texts[done["row"]], done["at"], count, REMOVED)), self.ranges)
                none = pa.nulls(len(table), pa.binary())
                yield from pa.table([table.column(0), none, none, none, table.column(1)], names=_DEALT).to_batches()
                name, record = name[~later], record[~later]
            at = ((name >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            record, at = record[order], at[order]
            used, head = np.unique(at, return_index=True)
            blobs, id_blobs, text_blobs = [], [], []
            for a, b in zip(head, np.append(head[1:], len(at)), strict=True):
                part = record[a:b].copy()
                rows, part["row"] = np.unique(part["row"], return_inverse=True)
                blobs.append(part.tobytes())
                id_blobs.append(ids[rows].tobytes())
                text_blobs.append(texts[rows].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(x, pa.binary()) for x in (blobs, id_blobs, text_blobs)), pa.nulls(len(used), pa.binary())], names=_DEALT)
        self.clear()

    @staticmethod
    def _later(content: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which records have a content that a smaller document among them has."""
        order = np.lexsort((ids, content))
        head = np.flatnonzero(np.append(True, content[order][1:] != content[order][:-1]))
        own = ids[order]
        out = np.empty(len(ids), bool)
        out[order] = own > np.repeat(own[head], np.diff(np.append(head, len(ids))))
        return out


_DEALT = ["range", "records", "ids", "texts", "spans"]
#: Rows hold records of one range of names, or spans that are settled already, of one bucket of documents.
DEALT = "range int, records binary, ids binary, texts binary, spans binary"
SPANS = "bucket int, spans binary"


def _gathered(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(records, identifier of each, text hash of each) of one range."""
    records, ids, texts = [np.zeros(0, kind)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, i, t in zip(*(table.column(c).to_pylist() for c in ("records", "ids", "texts")), strict=True):
        if r is not None:
            records.append(np.frombuffer(r, kind))
            ids.append(np.frombuffer(i, np.int64)[records[-1]["row"]])
            texts.append(np.frombuffer(t, np.int64)[records[-1]["row"]])
    return np.concatenate(records), np.concatenate(ids), np.concatenate(texts)


def _settled(table: pa.Table) -> np.ndarray:
    """Spans that came settled."""
    return np.concatenate([np.zeros(0, _SPAN), *(np.frombuffer(x, _SPAN) for x in table.column("spans").to_pylist() if x is not None)])


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans of one kind in which those that follow each other in a document are one."""
    s = spans[np.lexsort((spans["at"], spans["text"], spans["id"]))]
    new = np.append(True, (s["id"][1:] != s["id"][:-1]) | (s["text"][1:] != s["text"][:-1]) | (s["at"][1:] != s["at"][:-1] + s["count"][:-1]))
    head = np.flatnonzero(new)
    out = s[head]
    last = np.append(head[1:], len(s)) - 1
    out["count"] = s["at"][last] + s["count"][last] - out["at"]
    return out


def _by_bucket(spans: np.ndarray, buckets: int) -> pa.Table:
    if not len(spans):
        return pa.table({"bucket": pa.array([], pa.int32()), "spans": pa.array([], pa.binary())})
    at = (mix64(spans["id"].view(np.uint64) ^ mix64(spans["text"].view(np.uint64))) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(at, kind="stable")
    spans, at = spans[order], at[order]
    used, head = np.unique(at, return_index=True)
    return pa.table({"bucket": used, "spans": pa.array([spans[a:b].tobytes() for a, b in zip(head, np.append(head[1:], len(at)), strict=True)], pa.binary())})


def _spans(ids: np.ndarray, texts: np.ndarray, at: np.ndarray, count: np.ndarray | int, kind: int) -> np.ndarray:
    out = np.empty(len(ids), _SPAN)
    out["id"], out["text"], out["at"], out["count"], out["kind"] = ids, texts, at, count, kind
    return out


REMOVED, OPEN = 0, 1


def _settle_runs(buckets: int):  # noqa: ANN202
    def settle(table: pa.Table) -> pa.Table:
        release_memory()
        r, ids, texts = _gathered(table, _RECORD)
        if not len(r):
            return _by_bucket(_settled(table), buckets)
        order = np.lexsort((ids, r["content"], r["anchor"]))
        r, ids, texts = r[order], ids[order], texts[order]
        new_anchor = np.append(True, r["anchor"][1:] != r["anchor"][:-1])
        new = new_anchor | np.append(True, r["content"][1:] != r["content"][:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(r)))
        owner = ids[head]  # the smallest document of each content
        later = ids > np.repeat(owner, size)
        group = np.flatnonzero(new_anchor[head])
        members = np.diff(np.append(group, len(head)))
        # an anchor with contents of different owners: the first occurrences are looked at string by string
        mixed = np.minimum.reduceat(owner, group) < np.maximum.reduceat(owner, group)
        looked = ~later & np.repeat(np.repeat(mixed, members), size)
        return _by_bucket(np.concatenate([_settled(table), *(_spans(ids[m], texts[m], r["at"][m], r["count"][m], kind) for m, kind in ((later, REMOVED), (looked, OPEN)))]), buckets)

    return settle


def _settle_strings(buckets: int):  # noqa: ANN202
    def settle(table: pa.Table) -> pa.Table:
        release_memory()
        r, ids, texts = _gathered(table, _STRING)
        if not len(r):
            return _by_bucket(_settled(table), buckets)
        order = np.lexsort((ids, r["content"]))
        r, ids, texts = r[order], ids[order], texts[order]
        head = np.flatnonzero(np.append(True, r["content"][1:] != r["content"][:-1]))
        later = ids > np.repeat(ids[head], np.diff(np.append(head, len(r))))
        return _by_bucket(np.concatenate([_settled(table), _spans(ids[later], texts[later], r["at"][later], 1, REMOVED)]), buckets)

    return settle


def _merged(at: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals that touch or overlap, sorted by (group, start): (start, end, group)."""
    top = int(end.max()) + 2 if len(end) else 1
    reach = np.maximum.accumulate(end + group * top)
    new = np.append(True, (at[1:] + group[1:] * top > reach[:-1]) | (group[1:] != group[:-1])) if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    return at[head], (np.maximum.reduceat(end, head) if len(head) else end), group[head]


def _gather_spans(length: int):  # noqa: ANN202
    def gather(table: pa.Table) -> pa.Table:
        """(id, text, removed, open): interval lists of each document as int32 pairs."""
        release_memory()
        s = np.concatenate([np.frombuffer(x, _SPAN) for x in table.column("spans").to_pylist()])
        s = s[np.lexsort((s["at"], s["kind"], s["text"], s["id"]))]
        new = np.append(True, (s["id"][1:] != s["id"][:-1]) | (s["text"][1:] != s["text"][:-1]))
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        columns = []
        for kind, more in ((REMOVED, length - 1), (OPEN, 0)):
            m = s["kind"] == kind
            at, end, own = _merged(s["at"][m].astype(np.int64), s["at"][m].astype(np.int64) + s["count"][m] + more, group[m])
            pairs = np.stack([at, end], 1).astype(np.int32)
            cut = np.searchsorted(own, np.arange(len(head) + 1))
            columns.append(pa.array([pairs[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()))
        return pa.table({"id": s["id"][head], "text": s["text"][head], "removed": columns[0], "open": columns[1]})

    return gather


FOUND = "id bigint, text bigint, removed binary, open binary"


def _small(df: DataFrame, column: str) -> DataFrame:
    size = df.agg(F.sum(F.length(column) + 32)).first()[0] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: id_col, spans (array<struct<start, end>>, bytes), kept (the other bytes).

    A byte is removed if a string of ``length`` bytes covers it that also starts in a document with a
    smaller identifier; strings are judged on the input. Identifiers are of any type that has an order.
    Null text counts as empty; a null identifier counts as larger than all others. Rows of the same
    identifier never remove from each other. Texts shorter than ``length`` stay whole. No rows in, no
    rows out.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        rows = rows.withColumn("key", F.coalesce(F.col("id").cast("bigint"), F.lit(_LAST)))
    else:  # numbers in the order of the identifiers: partitions of a range sort, and rows in them, are numbered in order
        order = rows.select(F.col("id").alias("own")).filter("own is not null").distinct().orderBy("own").withColumn("key", F.monotonically_increasing_id())
        order = written(order, "repeat-order")
        rows = rows.join(order, F.col("id") == F.col("own"), "left").select("id", F.coalesce("key", F.lit(_LAST)).alias("key"), "body")
    rows = rows.withColumn("hash", F.xxhash64("body"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    ranges = max(parts, int(total * 2 / (length - gram + 2)) // RANGE_RECORDS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        out = _Dealer(_RECORD, ranges)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, off in slices(*as_bytes(batch.column(2)), SLICE, texts=30_000):
                anchor, content, doc, at, count = runs(data, off, length, gram)
                # anchors are the least names around, so they are mixed again before they are dealt by range
                yield from out.add(mix64(anchor + np.uint64(0x632BE59BD9B4E019)), doc, ids[i:j], texts[i:j], anchor=(anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32), content=content, at=at, count=count)
        yield from out.hand_on()
        release_memory()

    spans = rows.select("key", "hash", "body").mapInArrow(deal, DEALT).groupBy("range").applyInArrow(_settle_runs(ranges), SPANS)
    first = written(spans.groupBy("bucket").applyInArrow(_gather_spans(length), FOUND), "repeat-runs")

    def deal_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        out = _Dealer(_STRING, ranges)
        half = length // 2
        for batch in batches:
            ids, texts, opened = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for i, j, data, off in slices(*as_bytes(batch.column(2)), SLICE, texts=30_000):
                names = Names(data)
                pairs = [np.frombuffer(opened[x].as_py(), np.int32).reshape(-1, 2).astype(np.int64) for x in range(i, j)]
                doc = np.repeat(np.arange(j - i), [len(p) for p in pairs])
                p = np.concatenate(pairs)
                n = p[:, 1] - p[:, 0]
                doc, at = np.repeat(doc, n), np.repeat(p[:, 0] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                left, right = names.of(at + off[doc], half), names.of(at + off[doc] + length - half, half)
                middle = names.of(at + off[doc] + half, length - 2 * half) if length % 2 else np.uint64(0)
                name = mix64(left + mix64(right ^ np.uint64(0x5851F42D4C957F2D)) + middle)
                yield from out.add(name, doc, ids[i:j], texts[i:j], content=name, at=at)
        yield from out.hand_on()

    open_rows = first.filter(F.length("open") > 0).select(F.col("id").alias("i"), F.col("text").alias("t"), "open")
    looked = rows.join(_small(open_rows, "open"), [rows.key == F.col("i"), rows.hash == F.col("t")]).select("key", "hash", "body", "open")
    spans = looked.mapInArrow(deal_open, DEALT).groupBy("range").applyInArrow(_settle_strings(ranges), SPANS)
    second = written(spans.groupBy("bucket").applyInArrow(_gather_spans(length), FOUND), "repeat-strings")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for i, j, data, off in slices(*as_bytes(batch.column(1))):
                spans, kept = [], []
                for x in range(i, j):
                    a, b = batch.column(2)[x].as_py(), batch.column(3)[x].as_py()
                    p = np.frombuffer((a or b"") + (b or b""), np.int32).reshape(-1, 2).astype(np.int64)
                    own = data[off[x - i] : off[x - i + 1]]
                    if len(p):
                        p = p[np.argsort(p[:, 0], kind="stable")]
                        s, e, _ = _merged(p[:, 0], p[:, 1], np.zeros(len(p), np.int64))
                        stay = np.ones(len(own), bool)
                        for u, v in zip(s, e, strict=True):
                            stay[u:v] = False
                        own = own[stay]
                        spans.append([{"start": u, "end": v} for u, v in zip(s.tolist(), e.tolist(), strict=True)])
                    else:
                        spans.append([])
                    kept.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(spans, span), pa.array(kept, pa.binary())], names=["id", "spans", "kept"])

    a = first.filter(F.length("removed") > 0).select(F.col("id").alias("i"), F.col("text").alias("t"), F.col("removed").alias("a"))
    b = second.select(F.col("id").alias("u"), F.col("text").alias("v"), F.col("removed").alias("b"))
    marked = rows.join(_small(a, "a"), [rows.key == F.col("i"), rows.hash == F.col("t")], "left").join(_small(b, "b"), [rows.key == F.col("u"), rows.hash == F.col("v")], "left")
    kind = docs.schema[id_col].dataType.simpleString()
    out = marked.select("id", "body", "a", "b").mapInArrow(cut, f"id {kind}, spans array<struct<start:int,end:int>>, kept binary")
    return out.withColumnRenamed("id", id_col)
