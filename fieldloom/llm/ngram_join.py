"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

Every distinct shingle set is a class, named by its smallest doc_id. Two sets can only reach the threshold if their sizes
are in one band (the ratio of sizes is at least the threshold) and if their prefixes, the first n - ceil(t n) + 1 shingles
in one global order, meet. So classes are dealt to tiles by prefix shingle, and a tile compares classes of one size band.
The order puts shingles that many sets of a task hold last, so that a passage on very many documents deals no tile of its
own; the order changes the work, never the result. Within a tile a pair must pass, in turn, the size band, the bound that
its places in both prefixes give, and the bitmap bound: a signature has a bit for the parity of the shingles hashed to it,
so the bits in which two signatures differ are at most the size of the symmetric difference. What is left is decided by
intersecting sorted arrays of all shingles of both texts.

Large groups of near copies are linked first: sets that share a minimum of one of four permutations are compared, by the
same bounds and exact intersections, with the smallest of their group only. Pairs within a component so found need no
further link; the tiles leave them out and find every link between components. Copies are never expanded into pairs.
Once components are known, the links of every set are counted by comparing all sets of its component, in tiles that keep
counts and no pairs.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; a text with fewer
words than a shingle has its whole sequence as its one shingle; sets are compared through keyed 64-bit hashes that no
pattern of words collides under by its form (two given shingles do with a probability of 2**-64); rows that repeat
a doc_id are one node of the graph that has the links of all its rows, and each row comes back with its own n_shingles;
rows with a null doc_id come back with a null component_id; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.bytehash import mix, shingle_sets
from fieldloom.llm.common import BROADCAST_ROWS, broadcast_if_small, groups, materialize, meet, steps, text_bytes, tidy
from fieldloom.llm.components import connected_components

U = np.uint64
#: Odd factors of the four permutations of shingle hashes.
_TURNS = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_COMMON = 1 << 18  # shingles put last in the order, at most
_COUNTED = 3 << 20  # shingles of a block of texts within which a task counts
_MEMBERS = 256  # members that are compared with one centre in one group
_SMALL = 8  # rows of a small tile
_TILE = 2048  # rows of a tile that are compared at once
_BLOCK_SETS = 256  # sets of a block of a component, while it has at most _BLOCKS blocks
_BLOCKS = 8
_BLOCK_SHINGLES = 2 << 20  # shingles of a block, about


def _sets(batch, size: int):
    """(row, set) for every row of a batch, in bounded steps."""
    raw, offsets = text_bytes(batch.column("text"))
    for lo, hi in steps(offsets):
        yield from enumerate(shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size), lo)


def common_shingles(docs: DataFrame, size: int, least: int = 3) -> np.ndarray:
    """Shingles that at least this many different sets of a block of texts hold, the most frequent _COMMON of them, sorted.

    Every text is read; the list has a fixed bound and only orders shingles."""

    @tidy
    def count(batches):
        def flush(held):
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= least
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["h", "n"])

        held, seen, rows = [], set(), 0
        for batch in batches:
            for _, h in _sets(batch, size):
                mark = (len(h), int(h.sum(dtype=np.uint64)))
                if mark in seen:
                    continue  # a copy
                seen.add(mark)
                held.append(h)
                rows += len(h)
                if rows >= _COUNTED:
                    yield flush(held)
                    held, seen, rows = [], set(), 0
        if held:
            yield flush(held)

    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "h").limit(_COMMON).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def parity_bits(h: np.ndarray, width: int) -> np.ndarray:
    """Signature of width bits (a power of two): bit i is the parity of the hashes that fall to i."""
    at = (mix(h) >> U(20)) & U(width - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=width).astype(np.uint8) & 1)


def width_of(n: int) -> int:
    return 1 << max(6, min(16, int(n - 1).bit_length() + 1)) if n > 1 else 64


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    a, b = (h * U(3) ^ (h >> U(32))).sum(dtype=np.uint64), mix(h ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signatures(docs: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, f1, f2 (fingerprint of the set), n, prefix, bits, mins of every document."""

    @tidy
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows, held = [], 0
            for k, h in _sets(batch, size):
                n = len(h)
                if n:
                    spots = np.searchsorted(common, h)
                    late = common[np.minimum(spots, len(common) - 1)] == h if len(common) else np.zeros(n, bool)
                    p = prefix_length(n, percent)
                    early = h[~late]
                    prefix = early[:p] if len(early) >= p else np.concatenate([early, h[late][: p - len(early)]])
                    rows.append((ids[k], *_fingerprint(h), n, prefix.view(np.int64), parity_bits(h, width_of(n)).tobytes(), [int((h * t).min().astype(np.int64)) for t in _TURNS]))
                    held += 8 * p + 200
                else:
                    rows.append((ids[k], 0, 0, 0, [], b"", []))
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "f1", "f2", "n", "prefix", "bits", "mins"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f1 long, f2 long, n long, prefix array<long>, bits binary, mins array<long>")


def _differing(a: bytes, na: int, b: bytes, nb: int) -> int:
    """Bits in which two parity signatures differ, the wider one folded to the narrower."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def bound_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose size band and bitmaps allow the threshold. nodes: node, n, bits."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    joined = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    @tidy
    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            keep = []
            for x, m, y, n in zip(batch.column("ba").to_pylist(), na, batch.column("bb").to_pylist(), nb, strict=True):
                most = (m + n - _differing(x, m, y, n)) // 2  # of shared shingles
                keep.append(100 * most >= percent * (m + n - most))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of doc_ids those whose whole texts reach the threshold, by intersecting sorted arrays.

    Members b of a centre a meet in groups of about _MEMBERS with a copy of the centre's array."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(_MEMBERS)).cast("int").alias("k"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("part"))
    dealt = materialize(dealt, "dealt")
    centres = dealt.select("a", "part").distinct().select(F.col("a").alias("_id"), "a", "part", F.lit(0).alias("role"))
    wanted = centres.unionByName(dealt.select(F.col("b").alias("_id"), "a", "part", F.lit(1).alias("role")))
    rows = dealt.count() * 2
    # a doc_id that several rows share is compared by each of its texts
    texts = docs.select("doc_id", "text").join(broadcast_if_small(wanted, rows, BROADCAST_ROWS), F.col("doc_id") == F.col("_id")).select("a", "part", "role", "doc_id", "text")

    @tidy
    def arrays(batches):
        for batch in batches:
            out, held, lo = [], 0, 0
            for k, h in _sets(batch, size):
                out.append(h.tobytes())
                held += 8 * len(h)
                if held > 4 << 20 or k == batch.num_rows - 1:
                    part = batch.slice(lo, k + 1 - lo)
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("part"), part.column("role"), part.column("doc_id"), pa.array(out, pa.binary())], names=["a", "part", "role", "doc_id", "h"])
                    out, held, lo = [], 0, k + 1

    dealt_sets = texts.mapInArrow(arrays, "a long, part int, role int, doc_id long, h binary")
    # an AQE-coalesced shuffle by group; sorted, so that a centre comes before its members
    dealt_sets = dealt_sets.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    @tidy
    def compare(batches):
        now, centre = None, []
        for batch in batches:
            found_a, found_b = [], []
            for a, part, role, b, h in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "doc_id", "h")), strict=True):
                x = np.frombuffer(h, np.uint64)
                if (a, part) != now:
                    now, centre = (a, part), []
                if role == 0:
                    centre.append(x)
                    continue
                for c in centre:
                    short, long = (x, c) if len(x) < len(c) else (c, x)
                    if not len(short):
                        continue
                    at = np.searchsorted(long, short)
                    same = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                    if 100 * same >= percent * (len(x) + len(c) - same):
                        found_a.append(a)
                        found_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return dealt_sets.mapInArrow(compare, "a long, b long")


def _folded(bits: list[bytes], widths: np.ndarray, width: int) -> np.ndarray:
    """Signatures folded to width bytes; rows of narrower ones stay zero."""
    out = np.zeros((len(bits), width), np.uint8)
    for k in np.flatnonzero(widths >= width):
        x = np.frombuffer(bits[k], np.uint8)
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def _tile_pairs(node, comp, n, place, bits: list[bytes], percent: int):
    """Pairs of a tile's rows (sorted by size) of different components that size band, places and signatures allow, block
    by block."""
    rest = n - place  # shingles from the shared one on
    widths = np.array([len(x) for x in bits])
    folds: dict[int, np.ndarray] = {}
    for lo in range(0, len(n), _TILE):
        hi = min(lo + _TILE, len(n))
        top = int(np.searchsorted(n, n[hi - 1] * 100 // percent, side="right"))
        for at in range(lo, top, _TILE):
            to = min(at + _TILE, top)
            a, b = slice(lo, hi), slice(at, to)
            need = percent * (n[a, None] + n[None, b])
            most = np.minimum(rest[a, None], rest[None, b])
            ok = ((100 + percent) * most >= need) & (comp[a, None] != comp[None, b]) & (n[a, None] * 100 >= n[None, b] * percent)
            if at == lo:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            i, j = i + lo, j + at
            narrow = np.minimum(widths[i], widths[j])
            for width in np.unique(narrow).tolist():
                if width not in folds:
                    folds[width] = _folded(bits, widths, width)
                m = folds[width]
                x, y = i[narrow == width], j[narrow == width]
                for k in range(0, len(x), 1 << 14):
                    u, v = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
                    shared = (n[u] + n[v] - np.bitwise_count(m[u] ^ m[v]).sum(1, dtype=np.int64)) // 2
                    good = 100 * shared >= percent * (n[u] + n[v] - shared)
                    if good.any():
                        yield np.minimum(node[u[good]], node[v[good]]), np.maximum(node[u[good]], node[v[good]])


def _edges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first, np.concatenate([first[1:], [len(key)]])


def mixed_tiles(postings: DataFrame, percent: int) -> DataFrame:
    """Of the postings (key, node, comp, spot: size and place) tiles in which several components meet: pairs of small
    tiles that size band and places allow (kind 0: node and comp are the pair), and the rows of larger tiles (kind 1)."""
    dealt = postings.repartition("key").sortWithinPartitions("key", "spot")
    names = ["kind", "key", "node", "comp", "spot"]

    @tidy
    def run(batches):
        for table in groups(batches, ["key"]):
            key, node, comp, spot = (table.column(c).to_numpy() for c in names[1:])
            first, last = _edges(key)
            mixed = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)
            size = np.where(mixed, last - first, 0)
            n, rest = spot >> 20, (spot >> 20) - (spot & 0xFFFFF)
            xs, ys = [], []
            for m in range(2, _SMALL + 1):
                at = first[size == m]
                for i in range(m if len(at) else 0):
                    for j in range(i + 1, m):
                        a, b = at + i, at + j
                        ok = (comp[a] != comp[b]) & (n[a] * 100 >= n[b] * percent) & ((100 + percent) * np.minimum(rest[a], rest[b]) >= percent * (n[a] + n[b]))
                        xs.append(np.minimum(node[a[ok]], node[b[ok]]))
                        ys.append(np.maximum(node[a[ok]], node[b[ok]]))
            if xs:
                both = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], 1), axis=0)
                none = np.zeros(len(both), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(none.astype(np.int32)), pa.array(none), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(none)], names=names)
            large = np.flatnonzero(np.repeat(size > _SMALL, last - first))
            if len(large):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(large), np.int32)), *(pa.array(x[large]) for x in (key, node, comp, spot))], names=names)

    return dealt.mapInArrow(run, "kind int, key long, node long, comp long, spot long")


def tile_candidates(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a large tile and pass its bounds."""
    dealt = rows.withColumn("n", F.shiftright("spot", 20)).join(nodes.select("node", "n", "bits"), ["node", "n"])
    dealt = dealt.select("key", "spot", "node", "comp", "bits").repartition("key").sortWithinPartitions("key", "spot", "node")

    @tidy
    def run(batches):
        for table in groups(batches, ["key"]):
            node, comp, spot = (table.column(c).to_numpy() for c in ("node", "comp", "spot"))
            bits = table.column("bits")
            n, place = spot >> 20, spot & 0xFFFFF
            found = []
            for lo, hi in zip(*(x.tolist() for x in _edges(table.column("key").to_numpy())), strict=True):
                found += _tile_pairs(node[lo:hi], comp[lo:hi], n[lo:hi], place[lo:hi], bits.slice(lo, hi - lo).to_pylist(), percent)
            if found:
                both = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _partners(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of others every set reaches the threshold with, and the reverse; without others, of the rest of sets."""
    both = sets if others is None else sets + others
    n = np.array([len(x) for x in both], np.int64)
    order = np.argsort(n, kind="stable")
    first = order < len(sets)
    n = n[order]
    column = np.unique(np.concatenate([both[k] for k in order]), return_inverse=True)[1].astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    often = np.bincount(column)[column] > 1  # what one set holds is in no intersection
    column, kept = column[often], np.bincount(row[often], minlength=len(n))
    begin = np.concatenate([[0], np.cumsum(kept)])
    links = np.zeros(len(n), np.int64)
    mark = np.zeros(int(column.max(initial=0)) + 1, np.int32)
    for i in range(len(n)):
        top = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        if i + 1 >= top:
            continue
        mine = column[begin[i] : begin[i + 1]]
        mark[mine] = 1
        sums = np.concatenate([[0], np.cumsum(mark[column[begin[i + 1] : begin[top]]])])
        mark[mine] = 0
        same = np.diff(sums[begin[i + 1 : top + 1] - begin[i + 1]])
        good = 100 * same >= percent * (n[i] + n[i + 1 : top] - same)
        if others is not None:
            good &= first[i + 1 : top] != first[i]
        links[i] += good.sum()
        links[i + 1 : top] += good
    out = np.empty(len(n), np.int64)
    out[order] = links
    return out[: len(sets)], out[len(sets) :]


def count_links(docs: DataFrame, classes: DataFrame, final: DataFrame, size: int, percent: int) -> DataFrame:
    """f1, f2, n, links: of every set with a link the number of other sets that reach the threshold with it.

    classes: f1, f2, n, node; final: node, component. All links of a set are in its component. The sets of a component are
    dealt to blocks, and every two blocks of it meet in one tile, where links are counted and not kept: a set is copied
    once a block, up to _BLOCKS times, or more where blocks would hold over _BLOCK_SHINGLES shingles."""
    known = classes.join(final, "node")
    blocks = known.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).where("rows > 1")
    number = F.greatest(F.least(F.ceil(F.col("rows") / F.lit(_BLOCK_SETS)), F.lit(_BLOCKS)), F.ceil(F.col("shingles") / F.lit(_BLOCK_SHINGLES)))
    blocks = blocks.select("component", number.cast("int").alias("blocks"))
    wanted = materialize(known.join(blocks, "component").select("node", "component", "blocks").distinct(), "wanted")
    texts = docs.select("doc_id", "text").join(broadcast_if_small(wanted), F.col("doc_id") == F.col("node")).select("text", "component", "blocks")

    names = ["f1", "f2", "n", "component", "blocks", "h"]

    @tidy
    def sets(batches):
        for batch in batches:
            component, blocks = batch.column("component").to_pylist(), batch.column("blocks").to_pylist()
            rows, held = [], 0
            for k, h in _sets(batch, size):
                if len(h):
                    rows.append((*_fingerprint(h), len(h), component[k], blocks[k], h.tobytes()))
                    held += 8 * len(h) + 100
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = texts.mapInArrow(sets, "f1 long, f2 long, n long, component long, blocks long, h binary")
    # copies of a set have one block; tile: the smaller block, then the larger one
    rows = rows.withColumn("block", F.pmod(F.xxhash64("f1", "f2", "n"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "f1", "f2", "n", "h")
    rows = rows.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")

    @tidy
    def count(batches):
        for table in groups(batches, ["component", "low", "high"]):
            component, low, high, block, f1, f2, n = (table.column(c).to_numpy() for c in ("component", "low", "high", "block", "f1", "f2", "n"))
            h = table.column("h")
            edges = np.flatnonzero((np.diff(component) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
            out = []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(n)], strict=True):
                _, at = np.unique(np.stack([f1[lo:hi], f2[lo:hi], n[lo:hi]]), axis=1, return_index=True) if hi - lo > 1 else (None, np.zeros(1, np.int64))
                at += lo
                here = [np.sort(at[block[at] == b]) for b in sorted({low[lo], high[lo]})]
                if not all(map(len, here)):
                    continue
                held = [[np.frombuffer(h[k].as_py(), np.uint64) for k in x] for x in here]
                for x, links in zip(here, _partners(held[0], held[1] if len(held) > 1 else None, percent), strict=False):
                    x, links = x[links > 0], links[links > 0]
                    out.append((f1[x], f2[x], n[x], links))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["f1", "f2", "n", "links"])

    counted = rows.mapInArrow(count, "f1 long, f2 long, n long, links long")
    return counted.groupBy("f1", "f2", "n").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, with_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and, with_links, links: the number of other sets that reach the
    threshold with the row's own."""
    docs = docs.select("doc_id", "text")
    sigs = materialize(signatures(docs, size, percent, common_shingles(docs, size)), "signatures")
    full = sigs.where("n > 0 and doc_id is not null")
    keys = ["f1", "f2", "n"]
    sized = materialize(full.groupBy(*keys).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")), "classes")
    classes = sized.drop("rows")
    members = materialize(meet(full.select("doc_id", *keys), sized, keys, "rows").select("doc_id", "node", "n").distinct(), "members")
    heads = classes.select(F.col("node").alias("doc_id"), *keys)  # one row a class
    nodes = full.join(heads, ["doc_id", *keys], "left_semi").select(F.col("doc_id").alias("node"), "n", "prefix", "bits", "mins")

    # links between copies of one id's rows and its classes are edges of their own
    own = members.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).join(members.where("doc_id = node").select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi")

    grouped = nodes.select("node", "n", F.posexplode("mins").alias("turn", "low"))
    centres = grouped.groupBy("turn", "low").agg(F.min("node").alias("a"), F.max("node").alias("other")).where("a < other")
    stars = grouped.join(centres.select("turn", "low", "a"), ["turn", "low"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    found = materialize(verified(bound_pairs(stars, nodes.select("node", "n", "bits"), percent), docs, size, percent).unionByName(own).distinct(), "found")
    parts = connected_components(found)

    labelled = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    postings = labelled.select("node", F.col("component").alias("comp"), "n", F.posexplode("prefix").alias("place", "key"))
    postings = postings.select("key", "node", "comp", F.shiftleft("n", 20).bitwiseOR(F.least(F.col("place"), F.lit(0xFFFFF)).cast("long")).alias("spot"))
    tiles = materialize(mixed_tiles(postings, percent), "tiles")
    few = tiles.where("kind = 0").select(F.col("node").alias("a"), F.col("comp").alias("b")).distinct()
    slim = nodes.select("node", "n", "bits")
    pairs = bound_pairs(few, slim, percent).unionByName(tile_candidates(tiles.where("kind = 1"), slim, percent))
    pairs = materialize(pairs.distinct(), "pairs")
    more = materialize(verified(pairs, docs, size, percent).distinct(), "more")
    links = found.unionByName(more)
    final = materialize(connected_components(links), "components") if not more.isEmpty() else parts

    known = members.select("doc_id", "n", "node").distinct().join(final, "node", "left")
    known = known.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    # a document whose class is headed by another belongs to that component; its id may be the smallest of it
    out = sigs.select("doc_id", *keys).join(known, "doc_id", "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    if not with_links:
        return out.select(*columns)
    linked = materialize(count_links(docs, classes, final, size, percent).join(sized.select(*keys, "rows"), keys), "links")
    counted = meet(sigs.where("doc_id is not null").select("doc_id", *keys), linked, keys, "rows").distinct()
    out = out.join(counted, ["doc_id", *keys], "left")
    return out.select(*columns, F.coalesce("links", F.lit(0)).cast("long").alias("links"))
