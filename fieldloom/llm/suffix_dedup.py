"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if a string of `width` bytes that covers it also starts earlier, in a document of smaller doc_id or earlier in
its own. The strings of the whole corpus are dealt to shards so that equal strings meet: each string belongs to an anchor,
the least hash among the `gram`-byte strings in it, and an anchor's strings form a segment, a run of successive starts.
Equal strings have equal anchors, so an anchor that occurs once in the corpus deals nothing. Segments that are equal as a
whole are first reduced to their earliest copy, before the shuffle in every task and after it; the copies' decisions are
known. What is left of anchors with several distinct segments is sorted: a shard holds the texts of such segments, and the
suffix array with common prefixes, by external induced sorting, shows the classes of equal strings and the earliest of each.
A shard takes the segments that meet first near one place of one document, so neighbouring segments merge to one text;
groups of many copies fall apart by that place, and an anchor of many different segments has a shard of its own. Segments
count as equal by anchor and segment hash, 128 bits of two keyed hashes, of which that of the segment is not linear.

Defined results: null text counts as empty; documents shorter than width lose nothing; a null doc_id comes first in the
order; rows that repeat a doc_id count as one document, their equal starts do not match each other; ties do not occur, as
starts differ; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.bytehash import mix, run_hashes, window_hashes
from fieldloom.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, groups, longs, materialize, steps, text_bytes, tidy
from fieldloom.llm.external_queue import Log, Scratch
from fieldloom.llm.induced_sort import suffix_order

U = np.uint64
_FIRST = -(1 << 63)  # stands for a null doc_id
_STRETCH = 1024  # bytes of the first document whose segments share a shard
_CROWD = 256  # distinct segments of an anchor from which on it has a shard of its own
_BLOCK = 4 << 20  # bytes of text within which a task reduces equal segments
_MEMORY = 4 << 20  # bytes of a sorter's array beyond which it is a file
_ROWS = 1 << 16  # suffixes, or pieces, that are taken at once
_ONE = np.ones(1, np.int16)  # the symbol behind a piece
_SORT = 1 << 19  # bytes of distinct segments that one suffix array takes; an anchor's segments stay together


def segments(raw: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Of all strings of width bytes the runs with one anchor: text number, start, count, anchor hash, segment hash."""
    none = np.zeros(0, np.int64)
    if len(raw) < width:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    mixed = mix(window_hashes(raw, gram))
    place = np.arange(len(mixed), dtype=np.uint64)
    bits = U(32)  # of places; the upper bits of a hash choose, the leftmost of equal ones is least
    least = (mixed >> bits << bits) | place
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    n = np.diff(offsets)
    count = np.maximum(n - width + 1, 0)
    total = int(count.sum())
    if not total:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    text = np.repeat(np.arange(len(n)), count)
    start = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][text]
    chosen = least[start]
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    runs = np.diff(np.concatenate([first, [total]]))
    begin, of = start[first], text[first]
    anchor = mixed[(chosen[first] & ((U(1) << bits) - U(1))).astype(np.int64)]
    return of, begin - offsets[of], runs, anchor, run_hashes(raw, begin, begin + runs + width - 1)


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, sorted; spans that touch become one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[first], end[np.concatenate([first[1:] - 1, [len(end) - 1]])] if len(first) else end


def _earliest(anchor, seg, doc, start):
    """Order by (anchor, segment, doc, start); which rows are the first of their segment; the first row of each row's segment."""
    order = np.lexsort((start, doc, seg, anchor))
    a, s = anchor[order], seg[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order, first, head


def anchored(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """anchor, seg, doc, start, runs of the segments that are the earliest copies in their block of texts (kind 0), and
    the spans (kind 1: doc, start, end in runs) that their later copies cover."""

    @tidy
    def run(batches):
        def flush(held):
            doc, start, runs, anchor, seg = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first, head = _earliest(anchor, seg, doc, start)
            doc, start, runs, anchor, seg = (x[order] for x in (doc, start, runs, anchor, seg))
            yield table(0, anchor[first], seg[first], doc[first], start[first], runs[first])
            late = ~first & ((doc != doc[head]) | (start != start[head]))
            yield from covered(doc[late], start[late], start[late] + runs[late] + width - 1)

        def covered(doc, start, end):
            if not len(doc):
                return
            order = np.lexsort((start, doc))
            doc, start, end = doc[order], start[order], end[order]
            edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            parts = [(doc[lo], *merge_spans(start[lo:hi], end[lo:hi])) for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(doc)], strict=True)]
            d = np.concatenate([np.full(len(s), x) for x, s, _ in parts])
            s, e = np.concatenate([s for _, s, _ in parts]), np.concatenate([e for _, _, e in parts])
            zero = np.zeros(len(d), np.uint64)
            yield table(1, zero, zero, d, s, e)

        def table(kind, anchor, seg, doc, start, runs):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc), kind, np.int32)), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(doc), pa.array(start), pa.array(runs.astype(np.int64))],
                names=["kind", "anchor", "seg", "doc", "start", "runs"],
            )

        held, size = [], 0
        for batch in batches:
            ids = longs(batch.column("doc_id"), _FIRST)
            raw, offsets = text_bytes(batch.column("text"))
            for lo, hi in steps(offsets):
                of, start, runs, anchor, seg = segments(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width, gram)
                if len(of):
                    held.append((ids[lo:hi][of], start, runs, anchor, seg))
                size += int(offsets[hi] - offsets[lo])
                if size >= _BLOCK and held:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(run, "kind int, anchor long, seg long, doc long, start long, runs long")


def resolve(rows: DataFrame, width: int) -> DataFrame:
    """Of the earliest copies of all blocks, by anchor: spans that later copies cover (kind 1), and what is to be sorted
    (kind 0: doc, start, end, shard), the earliest copy of every segment of anchors that have several."""
    dealt = rows.select("anchor", "seg", "doc", F.shiftleft("start", 16).bitwiseOR(F.col("runs")).alias("at"))
    dealt = dealt.repartition("anchor").sortWithinPartitions("anchor", "seg", "doc", "at")

    @tidy
    def run(batches):
        for table in groups(batches, ["anchor"]):
            anchor, seg, doc, at = (table.column(c).to_numpy() for c in ("anchor", "seg", "doc", "at"))
            start, runs = at >> 16, at & 0xFFFF
            new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            first = new_anchor | np.concatenate([[True], seg[1:] != seg[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            late = ~first & ((doc != doc[head]) | (start != start[head]))
            group = np.cumsum(new_anchor) - 1
            several = np.bincount(group, first)[group] > 1
            send = np.flatnonzero(first & several)
            shard = np.zeros(len(doc), np.int64)
            if len(send):
                order = send[np.lexsort((start[send], doc[send], group[send]))]
                lead = np.concatenate([[True], group[order][1:] != group[order][:-1]])
                leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
                # an anchor of many segments has a shard of its own; equal strings have one anchor, so any split is whole
                many = np.bincount(group[order], minlength=int(group[-1]) + 1)[group[order]] > _CROWD
                place = np.where(many, start[leader] + (1 << 40), start[leader] // _STRETCH)
                key = mix(mix(doc[leader].view(np.uint64) + U(0x9E3779B97F4A7C15)) ^ place.astype(np.uint64))
                shard[order] = key.view(np.int64)
            out = np.concatenate([np.flatnonzero(late), send])
            kind = np.concatenate([np.ones(int(late.sum()), np.int32), np.zeros(len(send), np.int32)])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(doc[out]), pa.array(start[out]), pa.array((start + runs + width - 1)[out]), pa.array(shard[out])], names=["kind", "doc", "start", "end", "shard"])

    return dealt.mapInArrow(run, "kind int, doc long, start long, end long, shard long")


class Pieces:
    """Pieces (doc, start, bytes) of texts, one after the other on scratch, as the text of a suffix array."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.size, self.held = scratch, 0, []
        self.text, self.rows = Log(scratch, np.int16), Log(scratch, np.int64)

    def add(self, doc: int, start: int, data: bytes) -> None:
        self.held += (doc, start, self.size, len(data))
        self.text.append(np.frombuffer(data, np.uint8).astype(np.int16) + 2)
        self.text.append(_ONE)
        self.size += len(data) + 1
        if len(self.held) >= 4 * _ROWS:
            self._flush()

    def _flush(self) -> None:
        self.rows.append(np.array(self.held, np.int64))
        self.held = []

    def spans(self, width: int):
        """(doc, start, end) arrays of the runs of strings of width bytes that have an earlier equal in the pieces."""
        self._flush()
        self.text.append(_ONE - 1)
        rows = self.rows.array().reshape(-1, 4)
        first = rows[:, 2]
        order, shared = suffix_order(self.text.array(), 258, width, self.scratch)
        n = len(order)

        def places(lo, hi):
            """doc and start of the suffixes lo to hi, and whether width bytes lie in their piece."""
            at = np.asarray(order[lo:hi])
            row = rows[np.searchsorted(first, at, side="right") - 1]
            inside = at - row[:, 2]
            return row[:, 0], row[:, 1] + inside, inside + width <= row[:, 3]

        lo = 0
        while lo < n:
            hi = min(lo + _ROWS, n)
            if hi < n:  # up to the last class that ends here
                ends = np.flatnonzero(shared[lo + 1 : hi + 1] < width)
                if not len(ends):
                    while hi < n and (more := np.flatnonzero(shared[hi : hi + _ROWS] < width)).size == 0:
                        hi = min(hi + _ROWS, n)
                    hi += int(more[0]) if hi < n else 0
                    yield from self._large_class(places, lo, hi, width)
                    lo = hi
                    continue
                hi = lo + 1 + int(ends[-1])
            alike = shared[lo:hi] >= width
            alike[0] = False
            group = np.cumsum(~alike)
            alike[:-1] |= alike[1:]  # a suffix without a like neighbour is in no class
            if alike.any():
                doc, start, whole = (x[alike] for x in places(lo, hi))
                group, doc, start = group[alike][whole], doc[whole], start[whole]
                by = np.lexsort((start, doc, group))
                group, doc, start = group[by], doc[by], start[by]
                head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
                head = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
                late = (doc != doc[head]) | (start != start[head])
                yield from _runs_of(doc[late], start[late], width)
            lo = hi

    @staticmethod
    def _large_class(places, lo: int, hi: int, width: int):
        """Of one class of more suffixes than are taken at once: find the earliest, then hand on the others."""
        least = None
        for look in (True, False):
            for at in range(lo, hi, _ROWS):
                doc, start, whole = places(at, min(at + _ROWS, hi))
                if not whole[0]:
                    return  # a class's strings are all whole or none is
                if look:
                    k = np.lexsort((start, doc))[0]
                    here = (int(doc[k]), int(start[k]))
                    least = here if least is None else min(least, here)
                else:
                    late = (doc != least[0]) | (start != least[1])
                    yield from _runs_of(doc[late], start[late], width)


def _runs_of(doc: np.ndarray, start: np.ndarray, width: int):
    """Spans that strings of width bytes at these starts cover, overlapping ones as one."""
    if not len(doc):
        return
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    joins = (doc[1:] == doc[:-1]) & (start[1:] <= start[:-1] + width)
    first = np.flatnonzero(np.concatenate([[True], ~joins]))
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    yield doc[first], start[first], start[last] + width


def suffix_sorted(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Spans (doc, start, end) found by sorting the suffixes of the wanted segments, shard by shard."""
    wanted = materialize(wanted, "wanted")
    rows = wanted.count()
    # neighbouring segments of one shard and document become one text
    slim = wanted.repartition("doc").sortWithinPartitions("doc", "shard", "start")

    @tidy
    def join_segments(batches):
        for table in groups(batches, ["doc"]):
            doc, shard, start, end = (table.column(c).to_numpy() for c in ("doc", "shard", "start", "end"))
            first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1])])
            out = [(doc[lo], shard[lo], *merge_spans(start[lo:hi], end[lo:hi])) for lo, hi in zip(np.flatnonzero(first).tolist(), [*np.flatnonzero(first)[1:].tolist(), len(doc)], strict=True)]
            n = [len(s) for _, _, s, _ in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([d for d, *_ in out], n)), pa.array(np.repeat([h for _, h, *_ in out], n)), pa.array(np.concatenate([s for *_, s, _ in out])), pa.array(np.concatenate([e for *_, e in out]))],
                names=["doc", "shard", "start", "end"],
            )

    if not rows:
        return wanted.select("doc", "start", "end")
    spans = slim.mapInArrow(join_segments, "doc long, shard long, start long, end long")
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("shard", "start", "end")).alias("cuts"))
    spans = materialize(spans, "cuts")
    n = spans.agg(F.count(F.lit(1)), F.sum(F.size("cuts"))).first()
    small = (n[1] or 0) <= BROADCAST_ROWS and n[0] <= BROADCAST_ROWS
    texts = docs.withColumn("doc", F.coalesce("doc_id", F.lit(_FIRST))).drop("doc_id").join(F.broadcast(spans) if small else spans, "doc")

    @tidy
    def cut(batches):
        for batch in batches:
            held, size = [], 0
            for doc, text, cuts in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("cuts"), strict=True):
                data = (text.as_py() or "").encode()
                for c in cuts.as_py():
                    held.append((c["shard"], doc, c["start"], data[c["start"] : c["end"]]))
                    size += len(held[-1][3]) + 32
                if size > 4 << 20:
                    yield table(held)
                    held, size = [], 0
            if held:
                yield table(held)

    def table(held):
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "doc", "start", "data"])

    shards = texts.select("doc", "text", "cuts").mapInArrow(cut, "shard long, doc long, start long, data binary")
    shards = shards.repartition("shard").sortWithinPartitions("shard", "doc", "start")

    @tidy
    def sort(batches):
        with Scratch(_MEMORY) as scratch:
            pieces, now, at, seen = Pieces(scratch), None, None, set()
            for batch in batches:
                for shard, doc, start, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc", "start", "data")), strict=True):
                    if shard != now and pieces.size > _SORT:
                        yield from spans_of(pieces)
                        scratch.close()
                        pieces = Pieces(scratch)
                    if (shard, doc, start) != at:
                        now, at, seen = shard, (shard, doc, start), set()
                    if data not in seen:  # rows that repeat a doc_id
                        seen.add(data)
                        pieces.add(doc, start, data)
            if pieces.size:
                yield from spans_of(pieces)

    def spans_of(pieces):
        for found in pieces.spans(width):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["doc", "start", "end"])

    return shards.mapInArrow(sort, "doc long, start long, end long")


def repeated_spans(docs: DataFrame, width: int = 100, gram: int = 32) -> DataFrame:
    """doc, spans: of every document that loses bytes the merged spans, as little-endian pairs of 64-bit starts and ends."""
    docs = docs.select("doc_id", "text")
    rows = materialize(anchored(docs, width, gram), "segments")
    found = materialize(resolve(rows.where("kind = 0").select("anchor", "seg", "doc", "start", "runs"), width), "resolved")
    sorted_ = suffix_sorted(found.where("kind = 0").select("doc", "start", "end", "shard"), docs, width)
    spans = rows.where("kind = 1").select("doc", "start", F.col("runs").alias("end")).unionByName(found.where("kind = 1").select("doc", "start", "end")).unionByName(sorted_)
    dealt = spans.repartition("doc").sortWithinPartitions("doc", "start")

    @tidy
    def merge(batches):
        for table in groups(batches, ["doc"]):
            doc, start, end = (table.column(c).to_numpy() for c in ("doc", "start", "end"))
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])).tolist()
            out = [np.stack(merge_spans(start[lo:hi], end[lo:hi]), 1).astype("<i8").tobytes() for lo, hi in zip(first, [*first[1:], len(doc)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(out, pa.binary())], names=["doc", "spans"])

    return dealt.mapInArrow(merge, "doc long, spans binary")


def remove_repeats(docs: DataFrame, width: int = 100, gram: int = 32, as_text: bool = False) -> DataFrame:
    """All columns of docs with kept (binary: the remaining bytes), n_bytes, n_removed and n_spans of every row.

    as_text: kept is a string, without the bytes of characters that a removed span cut.

    The spans are broadcast while they are small; beyond that the texts are joined by a shuffle. Columns of docs with
    these names are replaced."""
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    spans = materialize(repeated_spans(docs, width, gram), "spans")
    size = spans.agg(F.count(F.lit(1)), F.sum(F.octet_length("spans"))).first()
    small = size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_BYTES
    spans = spans.withColumnsRenamed({"doc": "__doc", "spans": "__spans"})
    joined = docs.join(F.broadcast(spans) if small else spans, F.coalesce("doc_id", F.lit(_FIRST)) == F.col("__doc"), "left").drop("__doc")

    @tidy
    def run(batches):
        for batch in batches:
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("__spans").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                n_bytes.append(len(data))
                if found:
                    at, parts, gone = 0, [], 0
                    pairs = np.frombuffer(found, "<i8").reshape(-1, 2)
                    pairs = np.minimum(pairs, len(data))  # of rows that repeat a doc_id, a shorter one
                    for a, b in pairs.tolist():
                        parts.append(data[at:a])
                        gone += b - a
                        at = b
                    kept.append(b"".join([*parts, data[at:]]))
                    n_removed.append(gone)
                    n_spans.append(int((pairs[:, 1] > pairs[:, 0]).sum()))
                else:
                    kept.append(data)
                    n_removed.append(0)
                    n_spans.append(0)
            names = [c for c in batch.schema.names if c != "__spans"]
            if as_text:
                kept = [x.decode("utf-8", "ignore") for x in kept]
            more = [pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["kept string" if as_text else "kept binary", "n_bytes long", "n_removed long", "n_spans long"])
    return joined.mapInArrow(run, schema)


def digests(docs: DataFrame, width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return remove_repeats(docs.select("doc_id", "text"), width).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
