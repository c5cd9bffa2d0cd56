"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard verification, distributed union-find.

Lines are compared lower-cased and with white space collapsed. One hash of each shingle fills the bins of a one-permutation
MinHash (empty bins borrow from the next filled one); bands of bins are candidate keys. Keys are dealt into buckets, many in one row, and
sorted there by arrays; those of one line alone go. Lines that share a key meet first by the sizes of their shingle sets and bitmaps of parities, which
tell an exact bound of their similarity: most lines share a key by chance, and their texts stay where they are. The others meet in a task that
compares their shingle sets exactly and passes on a spanning forest of the pairs at or above the threshold. Groups of the same first line meet in
one place, where each text arrives once. A key of more than a block of
lines is dealt out anew: each line goes to one chunk, which all the key's representatives visit too, so that work grows with the
number of lines. Where that leaves a large key's lines in several components, these lines are looked at again by an exact prefix
filter: two sets that are similar enough share one of their rarest shingles, as many of which count as their sizes allow to differ. Lines
whose rarest shingles are common ones, as they vary too little, are compared by counts over their shingles' lines instead, the largest
component left out. Of each component of linked lines the first occurrence in the corpus (by doc_id, then place) stays.

Lines are normalised, hashed and cut into shingles in Arrow batches; counting, joining and putting texts together again are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.llm.common import SLICE_ROWS, components, durable, join_counted, let, slices, table

#: Characters of a shingle, least Jaccard similarity of their sets.
SHINGLE, SIMILAR = 6, 0.8
#: Bands and bins of each: a pair of similarity 0.8 shares a band with a chance of 99.6 %.
BANDS, ROWS = 14, 5
#: Lines of a key that meet in one task; a larger key is cut into chunks of half of it, which so many representatives visit.
BLOCK, REPRESENTATIVES = 512, 16
#: Keys of a bucket, about, and those that a task holds before it sends them on; a key with more lines than ``WIDE`` leaves a bucket that outgrows ``HELD`` keys.
DEALT, SENT, WIDE, HELD = 1 << 19, 1 << 19, 1 << 16, 1 << 22
#: Shingles are counted in so many buckets to tell the rare ones; a shingle is common if more than one in so many of the lines looked at again has
#: it; lines of a tile that are compared by counts.
BUCKETS, COMMON, TILE = 1 << 18, 16, 1_024
#: Bytes that may be broadcast in a join; more are shuffled.
SMALL = 8_000_000
#: Characters that are hashed together (their arrays fit a core's cache), and hashes of lines that a task remembers having sent.
SEGMENT, SEEN = 50_000, 250_000
#: Bits of a line in the filter by which texts are looked up, and of the whole filter.
BITS_EACH, MOST_BITS = 64, 1 << 27
#: Bits of a line's parities: as many as it has shingles, or the next power of two, between these bounds.
LEAST_PARITIES, MOST_PARITIES = 64, 4_096
#: Shingles by which a group's lines are multiplied at once.
COLUMNS = 4_096


def normal(line: str) -> str:
    low = line.lower()
    # printable text has no white space but plain spaces; most lines need no more
    if low.isprintable() and "  " not in low and low[:1] != " " and low[-1:] != " ":
        return low
    return " ".join(low.split())


def line_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def shingles(lines: list[str], kind: type = np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line index, hash) of each shingle of normalised lines, in pieces of bounded size; a shorter line is one shingle."""
    parts: list[str] = []
    owner: list[int] = []
    size = 0
    odd = [kind(x & np.iinfo(kind).max) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    half = kind(np.iinfo(kind).bits // 2)

    def work():
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(kind)
        lengths = np.array([len(p) for p in parts])
        two = codes[:-1] * odd[0] + codes[1:]
        two ^= two >> half
        h = two[: len(codes) - 5] * odd[1] + two[2 : len(codes) - 3]
        h ^= h >> half
        h *= odd[2]
        h += two[4:]
        h ^= h >> half
        h *= odd[3]
        h ^= h >> half
        inside = np.ones(len(h), bool)  # shingles that don't run on into the next part
        ends = np.cumsum(lengths)[:-1]
        for i in range(1, SHINGLE):
            inside[ends - i] = False
        return np.repeat(np.array(owner), lengths - SHINGLE + 1), h[inside]

    for i, line in enumerate(lines):
        line = line.ljust(SHINGLE, "\0")
        for a in range(0, max(1, len(line) - SHINGLE + 1), SEGMENT):
            part = line[a : a + SEGMENT + SHINGLE - 1]
            parts.append(part)
            owner.append(i)
            size += len(part)
            if size >= SEGMENT:
                yield work()
                parts, owner, size = [], [], 0
    if parts:
        yield work()


def band_keys(lines: list[str]) -> np.ndarray:
    """n x BANDS keys of normalised lines."""
    bins = BANDS * ROWS
    none = np.uint32(2**32 - 1)
    low = np.full(len(lines) * bins, none)
    for own, h in shingles(lines, np.uint32):
        place = (h >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16)
        np.minimum.at(low, own * bins + place, h)
    low = low.reshape(-1, bins).astype(np.uint64)
    bare = np.flatnonzero((low == none).any(axis=1))
    if len(bare):
        # an empty bin takes the value of the next filled one around the circle, mixed with how far that is
        some = low[bare]
        at = np.arange(2 * bins)
        filled = np.where(np.tile(some != none, 2), at, 2 * bins)
        source = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1][:, :bins]
        far = (source - np.arange(bins)).astype(np.uint64)
        low[bare] = np.take_along_axis(some, source % bins, 1) ^ far * np.uint64(0xD6E8FEB86659FD93)
    key = np.zeros((len(lines), BANDS), np.uint64)
    grid = low.reshape(-1, BANDS, ROWS)
    for r in range(ROWS):
        key = (key ^ grid[:, :, r]) * np.uint64(0xE7037ED1A0B428DB)
        key ^= key >> np.uint64(31)
    return (key ^ np.arange(BANDS, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each normalised line."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for own, h in shingles(texts):
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1  # in the order of the lines
        starts = [0, *cuts.tolist(), len(own)]
        for a, b in zip(starts, starts[1:]):
            parts[own[a]].append(h[a:b])
    out = []
    for p in parts:
        one = np.sort(p[0] if len(p) == 1 else np.concatenate(p))
        out.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
    return out


def parities(sets: list[np.ndarray]) -> list[bytes]:
    """Of each set a bitmap: whether the number of its hashes that fall on a bit is odd. A hash that one of two sets lacks changes one bit, so that they
    differ in at least as many hashes as bits."""
    sizes = np.array([len(x) for x in sets], np.int64)
    width = np.clip(1 << np.ceil(np.log2(sizes)).astype(np.int64), LEAST_PARITIES, MOST_PARITIES)
    ends = np.cumsum(width)
    at = np.concatenate(sets) & np.repeat((width - 1).astype(np.uint64), sizes)
    odd = np.bincount(at.astype(np.int64) + np.repeat(ends - width, sizes), minlength=ends[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip(((ends - width) // 8).tolist(), (ends // 8).tolist())]


def may_link(sizes: list[int], bitmaps: list[bytes], similar: float = SIMILAR) -> list[bool]:
    """Which sets may have a Jaccard similarity of ``similar`` or more to another of them, by their sizes and ``parities``; no set that has is missed.

    Sets of s and t elements that are similar enough differ in (1 - similar) / (1 + similar) * (s + t) elements at most. A bitmap of fewer bits
    is met by the wider one folded.
    """
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    size, width = [sizes[i] for i in order], [8 * len(bitmaps[i]) for i in order]
    bits = [int.from_bytes(bitmaps[i], "little") for i in order]
    most, out = (1 - similar) / (1 + similar), [False] * len(order)
    for i, s in enumerate(size):
        for j in range(i + 1, len(order)):
            if s < similar * size[j] - 1e-6:
                break
            if not (out[i] and out[j]):
                x, w = bits[j], width[j]
                while w > width[i]:
                    w >>= 1
                    x = x >> w ^ x & (1 << w) - 1
                if (x ^ bits[i]).bit_count() <= most * (s + size[j]) + 1e-6:
                    out[i] = out[j] = True
    found = [False] * len(order)
    for i, x in zip(order, out):
        found[i] = x
    return found


def likely_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lhash, place, groups) from rows (place, lhash, size, parities, groups) sorted by place: of each line's groups those where it may have a link."""

    def send() -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, ["lhash", "place", "groups"])

    out: list[tuple] = []
    rows = (row for batch in slices(batches) for row in zip(*(c.to_pylist() for c in batch.columns)))
    for place, at in groupby(rows, key=lambda r: r[0]):
        groups: dict[int, list[tuple]] = {}
        for row in at:
            for g in row[4]:
                groups.setdefault(g, []).append(row)
        found: dict[int, list[int]] = {}
        for g, members in groups.items():
            for row, some in zip(members, may_link([r[2] for r in members], [r[3] for r in members])):
                if some:
                    found.setdefault(row[1], []).append(g)
        out += [(h, place, g) for h, g in found.items()]
        if len(out) >= SLICE_ROWS:
            yield send()
            out = []
    if out:
        yield send()


def links_of(hashes: list[int], sets: list[np.ndarray], similar: float = SIMILAR, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose shingle sets have a Jaccard similarity of ``similar`` or more, over the components ``known`` so far.

    What the sets have in common is counted for all pairs at once, by products of the sets' indicators over the shingles that several have.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    label = np.arange(n) if known is None else np.array(known, np.int64)
    if n == 2:
        x, y = sets
        if label[0] == label[1] or min(len(x), len(y)) < similar * max(len(x), len(y)) - 1e-6:
            return []
        same = np.count_nonzero(x[np.minimum(x.searchsorted(y), len(x) - 1)] == y)
        return [(hashes[0], hashes[1])] if same >= similar * (len(x) + len(y) - same) - 1e-9 else []
    whole, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(whole)
    whole, owner = whole[order], owner[order]
    again = whole[1:] == whole[:-1]
    several = np.append(again, False) | np.append(False, again)
    column = np.cumsum(np.append(True, ~again)[several]) - 1
    owner = owner[several]
    same = np.zeros((n, n))
    for lo in range(0, column[-1] + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        has = np.zeros((n, column[b - 1] + 1 - lo), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        same += has @ has.T
    near = (same >= similar * (sizes[:, None] + sizes - same) - 1e-9) & (label[:, None] != label)
    out = []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        for j in np.flatnonzero(near[i] & (label != label[i])).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((hashes[i], hashes[j]))
    return out


def link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows (place, lhash, line, groups, component or null) sorted by place: whole places, many at a time. Lines of a place that have one of
    ``groups`` in common are compared, larger groups first, and those that are linked by then no more."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        lines = {r[1]: r[2] for r in rows}
        sets = dict(zip(lines, shingle_sets(list(lines.values()))))
        found: list[tuple[int, int]] = []
        for _, at in groupby(rows, key=lambda r: r[0]):
            label: dict[int, int] = {}
            groups: dict[int, list[int]] = {}
            for _, h, _, mine, component in at:
                label[h] = h if component is None else component
                for g in mine:
                    groups.setdefault(g, []).append(h)
            roots: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := roots.get(x, x)) != x:
                    roots[x] = roots.get(up, up)
                    x = up
                return x

            for hashes in sorted(groups.values(), key=len, reverse=True):
                known = [root(label[h]) for h in hashes]
                if len(set(known)) > 1:
                    links = links_of(hashes, [sets[h] for h in hashes], known=known)
                    for x, y in links:
                        roots[root(label[x])] = root(label[y])
                    found += links
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    open_rows: list[tuple] = []
    size = 0
    for batch in slices(batches, 2):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > SEGMENT and row[0] != open_rows[-1][0]:
                yield work(open_rows)
                open_rows, size = [], 0
            open_rows.append(row)
            size += len(row[2])
    if open_rows:
        yield work(open_rows)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")


def _lines(text: str) -> list[str]:
    return [normal(line) if line and not line.isspace() else "" for line in text.split("\n")]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, lhash, keys) of each line that isn't blank; ``th`` tells rows of one doc_id apart. Two lines are the same line if
    their 64-bit hashes are equal. The band keys of a line are null where the task has sent them before, as far as it remembers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 1, 256):
            doc, th, no, lh, fresh, new = [], [], [], [], [], []
            for d, text, t in zip(*(c.to_pylist() for c in batch.columns)):
                for i, line in enumerate(_lines(text)):
                    if line:
                        h = line_hash(line)
                        doc.append(d)
                        th.append(t)
                        no.append(i)
                        lh.append(h)
                        fresh.append(h not in seen)
                        if fresh[-1]:
                            seen.add(h)
                            new.append(line)
            if len(seen) > SEEN:
                seen.clear()
            sizes = np.where(fresh, BANDS, 0) if fresh else np.zeros(0, int)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.append(sizes == 0, False))
            keys = pa.ListArray.from_arrays(offsets, pa.array(band_keys(new).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(no, pa.int32()), pa.array(lh, pa.int64()), keys], ["doc_id", "th", "line_no", "lhash", "keys"])

    return _rows(docs).withColumn("th", F.xxhash64("text")).mapInArrow(work, "doc_id long, th long, line_no int, lhash long, keys array<long>")


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``lhash``: bit h modulo its size, a power of two of ``BITS_EACH`` a row up to ``MOST_BITS``, is set. Others have their bit set by chance."""
    bits = min(MOST_BITS, max(64, 1 << (BITS_EACH * hashes.count() - 1).bit_length()))
    bit = F.col("lhash").bitwiseAND(bits - 1)
    words = hashes.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(lhash & 63 as int))")).alias("set")).toArrow()  # a bounded number
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return out


def _texts_of(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(lhash, line, size, parities) of the lines of ``docs`` with these ``lhash``, each mostly once a task, and of some others; ``size`` counts shingles."""
    shipped = docs.sparkSession.sparkContext.broadcast(_filter_of(hashes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        words = shipped.value
        for batch in slices(batches, 0, 256):
            lines = [line for text in batch.column(0).to_pylist() for line in _lines(text) if line]
            h = np.array([line_hash(line) for line in lines], np.int64)
            wanted = np.flatnonzero(words[(h >> 6) & (len(words) - 1)] >> (h & 63) & 1)
            new: dict[int, str] = {}
            for i, x in zip(wanted.tolist(), h[wanted].tolist()):
                if x not in seen:
                    seen.add(x)
                    new[x] = lines[i]
            if len(seen) > SEEN:
                seen.clear()
            texts = list(new.values())
            sizes, bitmaps, at, chars = [], [], 0, 0
            for i, line in enumerate(texts, 1):  # shingle sets of bounded size at once
                chars += len(line)
                if chars > SEGMENT or i == len(texts):
                    sets = shingle_sets(texts[at:i])
                    sizes += map(len, sets)
                    bitmaps += parities(sets)
                    at, chars = i, 0
            columns = [pa.array(list(new), pa.int64()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lhash", "line", "size", "parities"])

    return _rows(docs).select("text").mapInArrow(work, "lhash long, line string, size int, parities binary")


def _chosen(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """(lhash, line) of the stored ``texts`` with these ``lhash``, once each, and of some others; most other lines' texts are not shuffled."""
    shipped = texts.sparkSession.sparkContext.broadcast(_filter_of(hashes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((words[(h >> 6) & (len(words) - 1)] >> (h & 63) & 1).astype(bool)))

    return texts.select("lhash", "line").mapInArrow(work, "lhash long, line string").dropDuplicates(["lhash"])


def _grouped(members: DataFrame) -> DataFrame:
    """(a, b) of rows (place, lhash, line, groups, component)."""
    members = members.select("place", "lhash", "line", "groups", "component").repartition("place").sortWithinPartitions("place")
    return members.mapInArrow(link_groups, "a long, b long").distinct()


def _deal(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, pairs) from rows (lhash, keys): (key, lhash) of many lines in one binary value for each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            pairs = np.concatenate(held)
            at = (pairs[:, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            at = at.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(at, kind="stable")
            some, first = np.unique(at[order], return_index=True)
            offsets = np.append(first, len(at)).astype(np.int32) * np.int32(16)
            data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(pairs[order])])
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), data], ["bucket", "pairs"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            keys = batch.column(1)
            sizes = pa.compute.list_value_length(keys).to_numpy(zero_copy_only=False)
            held.append(np.stack((keys.flatten().to_numpy(zero_copy_only=False), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)), axis=1))
            size += len(held[-1])
            if size >= SENT:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    return work


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lhash, lo, lines) of the keys that several lines have, from rows (bucket, pairs) sorted by bucket. The new ``key`` is a digest of the key's
    lines, so that keys of the same lines are one; ``lo`` is the smallest of them, ``lines`` their number. A key of very many lines stays itself,
    its lines are sent on unsorted and may repeat, and ``lines`` is null."""

    def rows(key: np.ndarray, lhash: np.ndarray, lo: np.ndarray, lines: np.ndarray | None = None) -> pa.RecordBatch:
        number = pa.nulls(len(key), pa.int64()) if lines is None else pa.array(lines, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(lhash, pa.int64()), pa.array(lo, pa.int64()), number], ["key", "lhash", "lo", "lines"])

    def apart(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs in the order of their keys, and where keys begin."""
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        pairs = pairs[new]
        return pairs, np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0])[: len(pairs)])

    def narrow(pairs: np.ndarray, wide: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of other keys, pairs of the keys that are ``wide`` or become so)."""
        pairs, first = apart(pairs)
        sizes = np.diff(np.append(first, len(pairs)))
        wide.update(pairs[first[sizes > WIDE], 0].tolist())
        out = np.isin(pairs[:, 0], np.array(sorted(wide), np.int64))
        return pairs[~out], pairs[out]

    def work(pairs: np.ndarray) -> pa.RecordBatch:
        pairs = pairs[np.argsort(pairs[:, 0])]
        same = pairs[1:, 0] == pairs[:-1, 0]
        pairs, first = apart(pairs[np.append(same, False) | np.append(False, same)])
        if not len(pairs):
            return rows(*[pairs[:, 0]] * 4)
        sizes = np.diff(np.append(first, len(pairs)))
        mixed = pairs[:, 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
        digest = np.bitwise_xor.reduceat(mixed ^ mixed >> np.uint64(32), first).view(np.int64)
        several = np.repeat(sizes > 1, sizes)
        return rows(*[x[several] for x in (np.repeat(digest, sizes), pairs[:, 1], np.repeat(pairs[first, 1], sizes), np.repeat(sizes, sizes))])

    held: list[np.ndarray] = []
    size, most, bucket, wide = 0, HELD, None, set()
    for batch in slices(batches, 1):
        for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if at != bucket and held:
                pairs = np.concatenate(held)
                if wide:
                    pairs, out = narrow(pairs, wide)
                    yield rows(out[:, 0], out[:, 1], out[:, 1])
                yield work(pairs)
                held, size, most, wide = [], 0, HELD, set()
            bucket = at
            held.append(np.frombuffer(blob, np.int64).reshape(-1, 2))
            size += len(held[-1])
            if size > most:
                pairs, out = narrow(np.concatenate(held), wide)
                held, size, most = [pairs], len(pairs), HELD + len(pairs)
                yield rows(out[:, 0], out[:, 1], out[:, 1])
    if held:
        pairs = np.concatenate(held)
        if wide:
            pairs, out = narrow(pairs, wide)
            yield rows(out[:, 0], out[:, 1], out[:, 1])
        yield work(pairs)


def shared_keys(lines: DataFrame) -> DataFrame:
    """(key, lhash, lo, lines) of the keys that several lines of a stored ``line_table`` have, as ``_meet`` has them; rows may repeat."""
    fresh = lines.filter("keys is not null").select("lhash", "keys")
    dealt = fresh.mapInArrow(_deal(max(1, BANDS * lines.count() // DEALT)), "bucket int, pairs binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "key long, lhash long, lo long, lines long")


def fuzzy_links(docs: DataFrame, lines: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b): hashes of different ``lines`` (a stored ``line_table`` of ``docs``) that join them into their components, but for those that chunks of
    large keys keep apart; (key, lhash) of the large keys; (lhash, line) of lines with shared keys, which may repeat."""
    shared = durable(shared_keys(lines), "line_keys")
    wide = shared.filter("lines is null").select("key", "lhash").distinct()
    wide = wide.join(F.broadcast(wide.groupBy("key").agg(F.count("*").alias("lines"))), "key")  # a row for each of very many lines
    large = durable(shared.filter(F.col("lines") > block).select("key", "lhash", "lines").distinct().unionByName(wide.select("key", "lhash", "lines")), "line_members")

    mixed = F.xxhash64("key", "lhash")
    chunk = F.pmod(mixed, F.ceil(F.col("lines") / F.lit(block // 2))).cast("int")
    # representatives: those of the smallest mixed hashes, found by a threshold that keeps about as many of every large key
    least = -(2**63) + F.floor(F.lit(float(REPRESENTATIVES) * 2**64) / F.col("lines")).cast("decimal(38,0)")
    chosen = large.filter(mixed.cast("decimal(38,0)") < least).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("lines") / F.lit(block // 2)).cast("int") - 1)))
    columns = ["key", "chunk", "lhash"]
    chunks = large.withColumn("chunk", chunk).select(columns).unionByName(chosen.select(columns)).withColumn("place", F.xxhash64("key", "chunk"))
    # the same lines' keys are one group, and groups of the same first line one place
    each = shared.filter(F.col("lines") <= block).select("lhash", F.struct(F.col("lo").alias("place"), F.col("key").alias("group")).alias("at"))
    each = each.unionByName(chunks.select("lhash", F.struct("place", F.col("place").alias("group")).alias("at")))
    places = durable(each.groupBy("lhash").agg(F.collect_set("at").alias("at")), "line_places")
    texts = durable(_texts_of(docs, places.select("lhash")), "line_texts")
    met = texts.select("lhash", "size", "parities").dropDuplicates(["lhash"]).join(places, "lhash")
    met = met.withColumn("place", F.explode(F.array_distinct(F.transform("at", lambda x: x["place"]))))
    groups = F.transform(F.filter("at", lambda x: x["place"] == F.col("place")), lambda x: x["group"])
    met = met.select("place", "lhash", "size", "parities", groups.alias("groups")).repartition("place").sortWithinPartitions("place")
    # the texts of lines that may have a link go to those places alone
    likely = met.mapInArrow(likely_members, "lhash long, place long, groups array<long>")
    likely = durable(likely.groupBy("lhash").agg(F.collect_list(F.struct("place", "groups")).alias("at")), "line_likely")
    members = _chosen(texts, likely.select("lhash")).join(likely, "lhash").select("lhash", "line", F.explode("at").alias("at"))
    members = members.select("at.place", "lhash", "line", "at.groups", F.lit(None).cast("long").alias("component"))
    return _grouped(members), large.select("key", "lhash"), texts.select("lhash", "line")


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, 0):
        for one in shingle_sets(batch.column(0).to_pylist()):
            np.add.at(total, (one % np.uint64(BUCKETS)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def prefix(one: np.ndarray, counts: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles, how often each, first): the rarest shingles of a set, of which every similar set that isn't larger has one among its own ``first``, and
    every similar larger set among all of its own.

    Sets of sizes s <= t share similar / (1 + similar) * (s + t) shingles or more if they are similar: at least similar * t, and at least 2 similar /
    (1 + similar) * s. So in one order of all shingles one of the first s - 2 similar / (1 + similar) * s + 1 of the smaller set is among the first
    t - similar * t + 1 of the larger.
    """
    n = len(one)
    often = counts[(one % np.uint64(BUCKETS)).astype(np.int64)]
    order = np.lexsort((one, often))[: n - int(np.ceil(similar * n - 1e-6)) + 1]
    return one[order], often[order], n - int(np.ceil(2 * similar / (1 + similar) * n - 1e-6)) + 1


def links_by_counts(hashes: list[int], sets: list[np.ndarray], known: list[int], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """``links_of`` for sets that have most shingles in common: each set outside the largest component counts what it shares with all others at once."""
    sizes = np.array([len(x) for x in sets])
    label = np.unique(np.array(known, np.int64), return_inverse=True)[1]
    whole, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(whole, kind="stable")
    whole, owner = whole[order], owner[order]
    out = []
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        lo, hi = np.searchsorted(whole, sets[i]), np.searchsorted(whole, sets[i], side="right")
        same = np.bincount(np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist())]), minlength=len(sets))
        for j in np.flatnonzero((label != label[i]) & (same >= similar * (sizes[i] + sizes - same) - 1e-9)).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((hashes[i], hashes[j]))
    return out


def link_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows (key, chunk, lhash, line, component) sorted by tile, a tile at a time."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        found = links_by_counts([r[2] for r in rows], shingle_sets([r[3] for r in rows]), [r[4] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    tile: list[tuple] = []
    for batch in slices(batches, 3):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if tile and row[:2] != tile[-1][:2]:
                yield work(tile)
                tile = []
            tile.append(row)
    if tile:
        yield work(tile)


def _tiles(members: DataFrame, lines: str, most: int) -> DataFrame:
    """``members`` (key, lhash, component) in one chunk, or, of keys with more than twice ``most`` rows (column ``lines``), once for each pair of chunks."""
    chunks = F.when(F.col(lines) <= 2 * most, 1).otherwise(F.ceil(F.col(lines) / F.lit(most))).cast("int")
    members = members.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("key", "lhash"), F.col("chunks")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(F.col("c"), o) * F.col("chunks") + F.greatest(F.col("c"), o))
    return members.withColumn("chunk", F.explode(tiles)).select("key", "chunk", "lhash", "component")


def _of_ids(joined: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``joined`` (id, component) of the few ``ids``, without a shuffle of all components where these ids fit a broadcast."""
    ids = durable(ids.distinct(), "line_ids")
    return durable(joined.join(F.broadcast(ids) if 8 * ids.count() <= SMALL else ids, "id"), "line_known")


def rare_links(large: DataFrame, texts: DataFrame, joined: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """(a, b): links that join components (``joined``: id, component) whose lines share a large key; None if no large key has two components."""
    known = _of_ids(joined, large.select(F.col("lhash").alias("id"))).withColumnRenamed("id", "lhash")
    members = large.join(known, "lhash", "left").select("key", "lhash", F.coalesce("component", "lhash").alias("component"))
    members = durable(members, "line_large")
    apart = durable(members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"), "line_apart")
    if not apart.take(1):
        return None
    members = members.join(apart, "key")
    ids = durable(members.select("lhash", "component").distinct(), "line_open_ids")
    open_lines = durable(_chosen(texts, ids.select("lhash")).join(ids, "lhash").select("lhash", "component", "line"), "line_open")
    counts = np.zeros(BUCKETS, np.int64)
    found = open_lines.select("line").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    common = max(block, open_lines.count() // COMMON)
    shipped = large.sparkSession.sparkContext.broadcast(counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 64):
            keys, rows, smaller = [], [], []
            for i, one in enumerate(shingle_sets(batch.column(2).to_pylist())):
                chosen, often, first = prefix(one, shipped.value)
                rare = (often > 1) & (often <= common)
                keys.append(chosen[rare])
                rows.append(np.full(rare.sum() + (often > common).any(), i))
                smaller.append(np.flatnonzero(rare) < first)
                if (often > common).any():  # key 0 tells that a common shingle counts
                    keys.append(np.zeros(1, np.uint64))
                    smaller.append(np.array([(often[:first] > common).any()]))
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(smaller) if smaller else np.zeros(0, bool))], ["key", "lhash", "component", "smaller"])

    rare = durable(open_lines.select("lhash", "component", "line").mapInArrow(work, "key long, lhash long, component long, smaller boolean"), "line_rare")
    own = rare.filter("key <> 0")
    groups = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("smaller").alias("some"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("lhash")).alias("x")).filter("lo < hi and some")
    groups = durable(groups.groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key")).select("key", F.col("n").alias("lines")), "line_groups")  # the same lines once
    texts = open_lines.select("lhash", "line")  # few of all lines with keys
    place = F.xxhash64("key", "chunk")
    more = _grouped(_tiles(own.join(groups, "key"), "lines", block // 2).join(texts, "lhash").withColumns({"place": place, "groups": F.array(place)}))

    # lines that only common shingles can tell apart: tiles of the large keys that they share
    dense = rare.filter("key = 0")
    if dense.filter("smaller").take(1):
        dense = durable(members.join(dense.select("lhash"), "lhash", "left_semi"), "line_dense")
        sizes = dense.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("lines")).filter("lo < hi").select("key", "lines")
        tiled = _tiles(dense.join(sizes, "key"), "lines", TILE)
        tiled = tiled.join(texts, "lhash").select("key", "chunk", "lhash", "line", "component").repartition("key", "chunk").sortWithinPartitions("key", "chunk")
        more = more.unionByName(tiled.mapInArrow(link_tiles, "a long, b long")).distinct()
    return more


def line_components(docs: DataFrame, lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lhash, component) of the lines that are linked to others."""
    links, large, texts = fuzzy_links(docs, lines, block)
    joined = durable(components(links), "line_components")
    more = rare_links(large, texts, joined, block)
    if more is None:
        return joined.withColumnRenamed("id", "lhash")
    # the links that were missing are links of components
    more = durable(more, "line_more")
    ids = more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    root = _of_ids(joined, ids)
    ends = more.join(root.select(F.col("id").alias("a"), F.col("component").alias("ra")), "a", "left").join(root.select(F.col("id").alias("b"), F.col("component").alias("rb")), "b", "left")
    merged = durable(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "line_merged")
    merged = merged.select(F.col("id").alias("component"), F.col("component").alias("whole"))
    every = joined.unionByName(ids.join(root, "id", "left_anti").withColumn("component", F.col("id")))
    every = every.join(merged, "component", "left").select(F.col("id").alias("lhash"), F.coalesce("whole", "component").alias("component"))
    return durable(every, "line_all_components")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, removed array<int>, n_removed): the lines of each row, by place, that repeat an earlier line."""
    lines = durable(line_table(docs), "lines")
    place = F.struct("doc_id", "th", "line_no")
    distinct = lines.groupBy("lhash").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    each = distinct.join(line_components(docs, lines), "lhash", "left").filter("n > 1 or component is not null")
    each = durable(each.withColumn("component", F.coalesce("component", "lhash")), "line_firsts")
    some, total = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    first = each.groupBy("component").agg(F.min("first").alias("kept"), F.count("*").alias("n"))
    each = durable(join_counted(each.select("lhash", "component", F.col("n").alias("lines")), first, "component", some), "line_kept")
    each = each.select("lhash", "kept", F.col("lines").alias("n"))
    gone = join_counted(lines.select("doc_id", "th", "line_no", "lhash"), each, "lhash", total).filter(place != F.col("kept"))
    # of one row's lines; rows that repeat wholly have the same places, and each keeps the first
    return durable(gone.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("removed")).withColumn("n_removed", F.size("removed")), "lines_removed")


def _with_kept(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """``docs`` with the kept lines as texts and, if it is named, a column of how many lines went."""
    gone = repeated_lines(docs)
    size = gone.agg(F.coalesce(F.sum(F.lit(32) + 4 * F.col("n_removed")), F.lit(0))).first()[0]
    gone = gone.select(F.col("doc_id").alias("__gone_id"), F.col("th").alias("__gone_th"), F.col("removed").alias("__removed"))
    on = docs["doc_id"].cast("long").eqNullSafe(gone["__gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__gone_th"])
    marked = docs.join(F.broadcast(gone) if size <= SMALL else gone, on, "left")
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), marked["__removed"])
    kept = let(F.split(marked["text"], "\n"), lambda lines: F.array_join(F.transform(places(lines), lambda i: F.get(lines, i)), "\n"))
    text = F.when(marked["__removed"].isNull(), marked["text"]).otherwise(kept).cast(docs.schema["text"].dataType)
    number = [] if removed is None else [F.coalesce(F.size(marked["__removed"]), F.lit(0)).alias(removed)]
    return marked.select(*[text.alias(c) if c == "text" else marked[c] for c in docs.columns], *number)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with the lines gone that repeat an earlier line, exactly or nearly.

    Blank lines stay, and null texts; an empty table gives an empty one. A document all of whose lines are repeats keeps its row, with an empty
    text (or its blank lines). Rows that repeat wholly keep the same lines each; rows with a null doc_id come first; of equal lines in one
    row the first stays. Very long lines and texts are compared whole. Other columns pass through, whatever their names.
    """
    return _with_kept(docs)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_kept, text): each document with its kept lines; the lines counted aren't blank."""
    docs = table(spark, sf_dir, "documents")
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?md)^[^\S\n]*[^\s]"))
    kept = _with_kept(docs.select("doc_id", "text", lines.alias("n_lines")), "n_removed")  # no blank line goes
    return kept.select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_removed")).alias("n_kept"), "text")
