"""Removal of repeated byte strings: suffix arrays by induced sorting, in shards.

A byte goes if a string of LENGTH bytes covers it that also starts in a document
with a smaller id. Documents are packed into bundles. Every window of LENGTH bytes
is named by the least hash of the GRAM-byte strings in it, so equal windows have
equal names, and neighbouring windows mostly share theirs. Names found in one
document only are settled; the rest of the text is cut into pieces, one for each
run of windows of one name, and a piece goes to the shard of its name. A shard
builds one suffix array over its distinct pieces (_suffix_array) and the common
prefix of each suffix with the one before it (_common_prefixes); windows that
share LENGTH bytes are neighbours there, and the least document of such a run is
known. A bundle sends a piece once and tells its other documents by itself, so a
string that every document holds reaches a shard once per bundle, not per document.
"""

import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import prepare, text_bytes
from trackloom.session import cut_lineage

LENGTH = 50
# Bytes of the strings whose hashes name a window; a window holds LENGTH - GRAM + 1.
GRAM = 22
# A bundle's text, the pieces sent to a shard (equal ones of different bundles merge
# there) and a bucket's text, in bytes, as sizes to aim at.
BUNDLE_BYTES = 4 << 20
SHARD_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
# Windows of a piece, at most: as many as a mask has bits.
RUN = 32
# A name that more bundles hold is split: each of its windows goes by its own bytes.
HOT_BUNDLES = 2048
_GAP = 0xFF  # between pieces; no byte of UTF-8


def _packed(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(pickle.dumps(parts, protocol=5))


def _unpacked(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


# Suffix arrays.

def _waves(sa, symbols, fill, stop, upward):
    """Induce suffixes of one type from those already placed, in waves.

    ``symbols`` has the first symbol of the suffixes of this type and the greatest
    number of its kind for others. ``fill`` is each bucket's next free slot and
    ``stop`` the end of its part. All slots up to the first free one are settled, so
    what they induce is placed at once: a stable grouping by symbol keeps their order.
    A slot left empty holds 0, and nothing stands before that.
    """
    n, buckets, other = len(sa), len(fill), np.iinfo(symbols.dtype).max
    # Views in the order in which buckets are met.
    mine, theirs = (fill, stop) if upward else (fill[::-1], stop[::-1])
    bucket, at = 0, 0 if upward else n
    while True:
        ahead = 8
        while bucket < buckets:  # the next bucket with a free slot
            free = mine[bucket:bucket + ahead] != theirs[bucket:bucket + ahead]
            first = int(free.argmax())
            if free[first]:
                bucket += first
                break
            bucket, ahead = bucket + len(free), 4 * ahead
        if upward:
            edge = int(mine[bucket]) if bucket < buckets else n
            before, at = sa[at:edge] - 1, edge
        else:
            edge = int(mine[bucket]) if bucket < buckets else 0
            before, at = sa[edge:at][::-1] - 1, edge
        own = symbols[before]  # -1 is the end of the text, which nothing induces
        kept = (own != other).nonzero()[0]
        if len(kept):
            own, before = own[kept], before[kept]
            order = own.argsort(kind="stable")
            own = own[order]
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            heads = fresh.nonzero()[0]
            bucket_of = own[heads]
            counts = np.empty(len(heads), np.int64)
            counts[:-1] = heads[1:] - heads[:-1]
            counts[-1] = len(own) - heads[-1]
            if upward:
                sa[np.repeat(fill[bucket_of] - heads, counts) + np.arange(len(own))] = before[order]
                fill[bucket_of] += counts
            else:
                sa[np.repeat(fill[bucket_of] - 1 + heads, counts) - np.arange(len(own))] = before[order]
                fill[bucket_of] -= counts
        if bucket >= buckets:
            return


def _induced(larger, smaller, counts, middle, firsts, lms):
    """Suffix array when the leftmost-smaller positions ``lms``, with the first
    symbols ``firsts``, come sorted."""
    ends = np.cumsum(counts)
    sa = np.zeros(int(ends[-1]), np.int32)
    held = np.bincount(firsts, minlength=len(counts))
    place = np.arange(len(lms)) - np.repeat(np.cumsum(held) - held, held)
    sa[ends[firsts] - held[firsts] + place] = lms
    _waves(sa, larger, ends - counts, middle, True)
    sa[0], ends[0] = len(sa) - 1, 0
    _waves(sa, smaller, ends, middle, False)
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string whose symbols are mostly different: ranks by
    twice as many symbols a round, for those that still share theirs."""
    n, width, rank = len(names), 1, names.astype(np.int64)
    order = rank.argsort(kind="stable")
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:n - width] = rank[width:] + 1
        own = rank[order]
        alone = np.ones(n + 1, bool)
        np.not_equal(own[1:], own[:-1], out=alone[1:-1])
        tied = np.flatnonzero(~(alone[1:] & alone[:-1]))
        if not len(tied):
            return order
        some = order[tied]
        some = some[np.lexsort((ahead[some], rank[some]))]
        order[tied] = some
        # A rank is the place of the first of those that share it.
        fresh = np.ones(len(some), bool)
        fresh[1:] = (rank[some[1:]] != rank[some[:-1]]) | (ahead[some[1:]] != ahead[some[:-1]])
        if width == 1:
            rank[order] = np.flatnonzero(alone[:-1])[np.cumsum(alone[:-1]) - 1]
        rank[some] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(some)), 0))]
        width *= 2


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting; ``text`` ends with its only 0.

    Suffixes are smaller (S) or larger than their right neighbour. The substrings
    between leftmost smaller positions are sorted by inducing once, named, and the
    string of names is sorted recursively where names repeat (where less than half
    do, by doubling); inducing from the sorted positions then gives the whole array.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    different = np.flatnonzero(text[1:] != text[:-1])
    rises = text[different + 1] > text[different]
    types = np.append(np.repeat(rises, np.diff(different, prepend=-1)), True)
    lms = np.flatnonzero(types[1:] & ~types[:-1]).astype(np.int32) + np.int32(1)
    counts = np.bincount(text)
    middle = np.cumsum(counts) - np.bincount(text[types], minlength=len(counts))  # larger ones stand before it
    none = np.iinfo(text.dtype).max
    larger, smaller = np.where(types, none, text), np.where(types, text, none)
    smaller[n - 1] = none
    by_symbol = lms[text[lms].argsort(kind="stable")]
    sa = _induced(larger, smaller, counts, middle, text[by_symbol], by_symbol)

    # Sorted substrings, each up to the next leftmost-smaller position.
    index = np.full(n, -1, np.int32)
    index[lms] = np.arange(len(lms))
    ranked = index[sa]
    ranked = ranked[ranked >= 0]
    size = np.diff(lms, append=np.int32(n - 1)) + 1
    a, b = ranked[:-1], ranked[1:]
    alike = size[a] == size[b]
    pair = np.flatnonzero(alike)
    if len(pair):
        spread = size[a[pair]]
        starts = (np.cumsum(spread) - spread).astype(np.int32)
        at = np.arange(int(spread.sum()), dtype=np.int32)
        off = text[at - np.repeat(starts - lms[a[pair]], spread)] != text[at - np.repeat(starts - lms[b[pair]], spread)]
        alike[pair] = ~np.logical_or.reduceat(off, starts)
    names = np.empty(len(lms), np.int32)
    names[ranked] = np.concatenate(([0], np.cumsum(~alike)))
    distinct = int(names.max()) + 1
    if distinct == len(lms):
        order = ranked
    elif 2 * distinct > len(lms):
        order = _doubled(names)
    else:
        order = _suffix_array(names)
    return _induced(larger, smaller, counts, middle, text[lms[order]], lms[order])


def _extended(words, i, j, known, cap):
    """Common bytes of the suffixes i and j up to ``cap``; the first ``known`` are given."""
    found, open_ = known.copy(), np.flatnonzero(known < cap)
    while len(open_):
        x = words[i[open_] + found[open_]] ^ words[j[open_] + found[open_]]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // 8).astype(np.int32))
        found[open_] += same.astype(np.int32)
        open_ = open_[(x == 0) & (found[open_] < cap)]
    return np.minimum(found, cap)


def _reaching(words, i, j, known, length):
    """Whether the suffixes i and j share ``length`` bytes; the first ``known`` are given."""
    found, open_ = known >= length, np.flatnonzero(known < length)
    known = known[open_]
    i, j = i[open_], j[open_]
    while len(open_):
        at = np.minimum(known, max(length - 8, 0))
        mask = np.uint64(0xFFFFFFFFFFFFFFFF >> max(8 * (8 - length), 0))
        same = np.flatnonzero(((words[i + at] ^ words[j + at]) & mask) == 0)
        open_, i, j, known = open_[same], i[same], j[same], at[same] + 8
        done = known >= length
        found[open_[done]] = True
        more = np.flatnonzero(~done)
        open_, i, j, known = open_[more], i[more], j[more], known[more]
    return found


def _common_prefixes(data: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares ``length`` bytes with the one before it in ``sa``,
    in text order.

    In text order a common prefix falls by at most one per position (it is permuted,
    not sorted). Every ``length // 2``-th position is measured, up to half as much
    again; the bound it gives settles or shortens the comparison of those behind it.
    """
    n, step = len(sa), max(length // 2, 1)
    padded = np.concatenate((data, np.full(2 * length + 16, _GAP, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).reshape(-1)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = sa[0]
    at = np.arange(n, dtype=np.int32)
    marks = at[::step]
    known = _extended(words, marks, before[marks], np.zeros(len(marks), np.int32), length + step)
    bound = np.maximum(np.repeat(known, step)[:n] - at % step, 0)
    found = _reaching(words, at, before, bound, length)
    found[sa[0]] = False
    return found


def least_owners(pieces: list[bytes], owners: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece and each of its windows, the least owner of that window."""
    sizes = np.array([len(x) for x in pieces], np.int64)
    data = np.frombuffer(b"".join(x + b"\xff" for x in pieces), np.uint8)
    text = np.append(data.astype(np.uint16) + np.uint16(1), np.uint16(0))
    sa = _suffix_array(text)
    shared = _common_prefixes(np.append(data, np.uint8(_GAP)), sa, length)
    run = np.cumsum(~shared[sa]) - 1
    owner = np.append(np.repeat(np.array(owners, np.int64), sizes + 1), np.iinfo(np.int64).max)
    least = np.minimum.reduceat(owner[sa], np.flatnonzero(np.diff(run, prepend=-1)))
    found = np.empty(len(sa), np.int64)
    found[sa] = least[run]
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    return [found[s:s + n - length + 1] for s, n in zip(starts, sizes)]


# Bundles and names.

def _bundler(batches):
    part, made = TaskContext.get().partitionId(), 0
    ids, texts, held = [], [], 0

    def bundle():
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + made], pa.int64()), pa.array([held], pa.int64()),
             pa.array([_packed(ids, np.array([len(x) for x in texts], np.int64), b"".join(texts))], pa.binary())],
            ["bundle", "size", "packed"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch)):
            if texts and held + len(text) > BUNDLE_BYTES or len(texts) >= BUNDLE_BYTES // 64:
                yield bundle()
                ids, texts, held, made = [], [], 0, made + 1
            ids.append(doc)
            texts.append(text)
            held += len(text)
    if texts:
        yield bundle()


def _power(base: int, times: int) -> np.uint64:
    return np.uint64(pow(base, times, 1 << 64))


def _names(text: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Name of the window at each position: the least hash of its grams."""
    count, most = len(text) - length + 1, 1 << 15  # parts that stay in the processor's cache
    return np.concatenate([_names_of(text[k:min(k + most, count) + length - 1], length, gram)
                           for k in range(0, count, most)])


def _names_of(text: np.ndarray, length: int, gram: int) -> np.ndarray:
    base = 0x9E3779B97F4A7C15
    rolled, made = {1: text.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * made <= gram:
        x = rolled[made]
        rolled[2 * made] = x[:len(x) - made] * _power(base, made) + x[made:]
        made *= 2
    count, at, hashes = len(text) - gram + 1, 0, None
    for part in sorted(rolled, reverse=True):
        if at + part <= gram:
            x = rolled[part][at:at + count]
            hashes = x if hashes is None else hashes * _power(base, part) + x
            at += part
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    width, least, made = length - gram + 1, hashes, 1
    while 2 * made <= width:
        least = np.minimum(least[:len(least) - made], least[made:])
        made *= 2
    count = len(text) - length + 1
    least = np.minimum(least[:count], least[width - made:width - made + count])
    least = (least ^ (least >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)  # least ones lie close together
    return least ^ (least >> np.uint64(29))


def _runs(ids, sizes, text: np.ndarray, length: int, gram: int):
    """name, first window, windows and document (place in the bundle) of each run
    of windows of one name; documents without id have none."""
    if len(text) < length:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    names = _names(text, length, gram)
    valid, ends = np.ones(len(names) + 1, bool), np.cumsum(sizes)
    valid[-1] = False
    for x, n, end in zip(ids, sizes.tolist(), ends.tolist()):
        valid[max(end - n, 0) if x is None else max(end - n, end - length + 1):end] = False
    head = valid[:-1].copy()
    head[1:] &= (names[1:] != names[:-1]) | ~valid[:-2]
    last = valid[:-1].copy()
    last[:-1] &= head[1:] | ~valid[1:-1]
    start, end = np.flatnonzero(head), np.flatnonzero(last) + 1
    parts = (end - start + RUN - 1) // RUN
    inside = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start, end = np.repeat(start, parts) + RUN * inside, np.repeat(end, parts)
    return names[start], start, np.minimum(end - start, RUN), np.searchsorted(ends, start, "right")


def _opened(blob: bytes):
    ids, sizes, text = _unpacked(blob)
    return ids, sizes, text, np.frombuffer(text, np.uint8)


# A name's bucket is its upper bits; the next 32 tell it apart there. Names that
# then still agree only make some text be compared for nothing.

def _keys(names: np.ndarray, bits: int) -> np.ndarray:
    return names >> np.uint64(32 - bits)


def _low(keys: np.ndarray) -> bytes:
    return keys.astype("<u4").tobytes()


def _of_low(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4")


def _namer(length: int, gram: int, bits: int):
    """bucket, bundle, and the names of the bundle there: first those of several documents."""
    def run(batches):
        for batch in batches:
            for bundle, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, sizes, _, text = _opened(blob)
                names, _, _, doc = _runs(ids, sizes, text, length, gram)
                if not len(names):
                    continue
                keys = _keys(names, bits)
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                doc = doc[order]  # in text order within a name
                several = doc[heads] != doc[np.append(heads[1:], len(doc)) - 1]
                keys = keys[heads]
                bucket = (keys >> np.uint64(32)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                found = [(bucket[s], k[m], k[~m]) for s, e in zip(cuts, cuts[1:])
                         for k, m in [(keys[s:e], several[s:e])]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.int64()), pa.array([bundle] * len(found), pa.int64()),
                     pa.array([_low(x[1]) for x in found], pa.binary()),
                     pa.array([_low(x[2]) for x in found], pa.binary())],
                    ["bucket", "bundle", "several", "single"])

    return run


def _sharer(hot: int):
    """Names of a bucket that two documents or more hold, back to each bundle."""
    def run(table: pa.Table) -> pa.Table:
        bundles = table.column("bundle").to_pylist()
        several = [_of_low(x) for x in table.column("several").to_pylist()]
        single = [_of_low(x) for x in table.column("single").to_pylist()]
        names, back, counts = np.unique(np.concatenate(several + single), return_inverse=True, return_counts=True)
        marked = np.zeros(len(names), bool)
        marked[back[:sum(map(len, several))]] = True
        shared, often = marked | (counts > 1), counts > hot
        out = []
        for bundle, a, b in zip(bundles, several, single):
            own = np.concatenate((a, b))
            place = np.searchsorted(names, own)
            kept, many = own[shared[place]], own[often[place]]
            if len(kept):
                out.append((bundle, _low(kept), _low(many), len(kept)))
        bucket = table.column("bucket")[0].as_py()
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([bucket] * len(out), pa.int64()),
                         pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary()),
                         pa.array([x[3] for x in out], pa.int64())], names=["bundle", "bucket", "shared", "hot", "n"])

    return run


def _member(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return held[place] == keys


def _cutter(length: int, gram: int, bits: int, shards: int):
    """Rows for the shards, and one with shard -1 that says where pieces stand."""
    def run(batches):
        for batch in batches:
            for bundle, blob, buckets in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids, sizes, raw, text = _opened(blob)
                names, start, windows, doc = _runs(ids, sizes, text, length, gram)

                def all_of(field):
                    got = [_of_low(x[field]).astype(np.uint64) | np.uint64(x["bucket"] << 32) for x in buckets]
                    return np.sort(np.concatenate(got))

                keys = _keys(names, bits)
                taken = _member(keys, all_of("shared"))
                names, start, windows, doc, keys = (x[taken] for x in (names, start, windows, doc, keys))
                split = _member(keys, all_of("hot"))
                if split.any():  # each window by itself
                    n = np.where(split, windows, 1)
                    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    names, start, windows, doc, split = (np.repeat(x, n) for x in (names, start, windows, doc, split))
                    start, windows = start + inside, np.where(split, 1, windows)
                place, owner, shard, entry = {}, [], [], np.empty(len(start), np.int64)
                for k, (s, n, d, name, alone) in enumerate(zip(start.tolist(), windows.tolist(), doc.tolist(),
                                                               names.tolist(), split.tolist())):
                    piece = raw[s:s + n + length - 1]
                    at = place.setdefault(piece, len(place))
                    if at == len(owner):
                        owner.append(ids[d])
                        shard.append((xxhash.xxh3_64_intdigest(piece) if alone else name * 0x9E3779B97F4A7C15 >> 20) % shards)
                    elif ids[d] < owner[at]:
                        owner[at] = ids[d]
                    entry[k] = at
                shard, owner, pieces = np.array(shard, np.int64), np.array(owner, np.int64), list(place)
                rows = [(-1, _packed(start.astype(np.int32), windows.astype(np.int8), doc.astype(np.int32),
                                     entry.astype(np.int32), shard.astype(np.int32), owner))]
                order = np.argsort(shard, kind="stable")
                cuts = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
                for s, e in zip(cuts, cuts[1:]):
                    own = order[s:e]
                    rows.append((int(shard[own[0]]), _packed([pieces[k] for k in own], owner[own])))
                for k in range(0, len(rows), 64):
                    some = rows[k:k + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bundle] * len(some), pa.int64()), pa.array([x[0] for x in some], pa.int32()),
                         pa.array([x[1] for x in some], pa.binary())], ["bundle", "shard", "packed"])

    return run


def _sorter(length: int):
    """For each bundle's pieces in a shard, the windows that a smaller document has too, as bits."""
    def run(table: pa.Table) -> pa.Table:
        place, owners, sent = {}, [], []
        for blob in table.column("packed").to_pylist():
            pieces, own = _unpacked(blob)
            at = [place.setdefault(x, len(place)) for x in pieces]
            for k, o in zip(at, own.tolist()):
                if k == len(owners):
                    owners.append(o)
                elif o < owners[k]:
                    owners[k] = o
            sent.append((np.array(at, np.int64), own))
        least = least_owners(list(place), owners, length)
        size = np.array([len(x) for x in least], np.int64)
        flat, heads = np.concatenate(least), np.cumsum(size) - size
        masks = []
        for at, own in sent:
            n = size[at]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            less = flat[np.repeat(heads[at], n) + inside] < np.repeat(own, n)
            bits = np.where(less, np.uint32(1) << inside.astype(np.uint32), np.uint32(0))
            masks.append(_packed(np.bitwise_or.reduceat(bits, np.cumsum(n) - n)))
        return pa.table([table.column("bundle"), table.column("shard"), pa.array(masks, pa.binary())],
                        names=["bundle", "shard", "packed"])

    return run


def _remover(length: int, kind: pa.DataType):
    def run(batches):
        for batch in batches:
            for blob, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, sizes, raw, text = _opened(blob)
                level = np.zeros(len(text) + 1, np.int64)
                home = next((x["packed"] for x in rows or [] if x["shard"] < 0), None)
                if home is not None:
                    start, windows, doc, entry, shard, owner = _unpacked(home)
                    masks = np.zeros(len(shard), np.uint32)
                    for x in rows:
                        if x["shard"] >= 0:
                            masks[shard == x["shard"]] = _unpacked(x["packed"])[0]
                    own = np.array([0 if x is None else x for x in ids], np.int64)[doc]
                    bits = np.where(own > owner[entry], np.uint32(0xFFFFFFFF), masks[entry])
                    windows = windows.astype(np.int64)
                    whole = np.uint32(0xFFFFFFFF) >> (RUN - windows).astype(np.uint32)
                    full, some = (bits & whole) == whole, ((bits & whole) != whole) & (bits != 0)
                    starts, ends = [start[full]], [start[full] + windows[full] - 1 + length]
                    start, windows, bits = start[some], windows[some], bits[some]
                    for k in range(RUN):
                        at = start[(bits >> np.uint32(k) & np.uint32(1) == 1) & (windows > k)] + k
                        starts.append(at)
                        ends.append(at + length)
                    level += np.bincount(np.concatenate(starts), minlength=len(level))
                    level -= np.bincount(np.concatenate(ends), minlength=len(level))
                gone = np.cumsum(level[:-1], dtype=np.int32) > 0
                at, out = 0, []
                for n in sizes.tolist():
                    if gone[at:at + n].any():
                        own = gone[at:at + n]
                        spans = np.flatnonzero(np.diff(own, prepend=False, append=False)).reshape(-1, 2).tolist()
                        out.append((n, [{"start": s, "end": e} for s, e in spans], text[at:at + n][~own].tobytes()))
                    else:
                        out.append((n, [], raw[at:at + n]))
                    at += n
                for k in range(0, len(out), 512):
                    some = out[k:k + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[k:k + 512], kind), pa.array([x[0] for x in some], pa.int64()),
                         pa.array([x[1] for x in some], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         pa.array([x[2] for x in some], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_BUNDLES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (start, end of removed runs, in
    bytes) and kept (the bytes that remain).

    A byte goes if a string of ``length`` bytes over it also starts in a document
    with a smaller doc_id; strings are those of the input and never cross documents.
    Null texts are empty. Rows that share a doc_id take nothing from each other;
    rows without one lose nothing and take nothing. An empty table gives an empty
    result; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bundles = cut_lineage(named.mapInArrow(_bundler, "bundle long, size long, packed binary"))
    total = bundles.agg(F.sum("size")).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    bits = min(max(2 * cores, total // BUCKET_BYTES).bit_length(), 24)

    names = bundles.select("bundle", "packed").mapInArrow(
        _namer(length, gram, bits), "bucket long, bundle long, several binary, single binary")
    shared = cut_lineage(names.groupBy("bucket").applyInArrow(
        _sharer(hot), "bundle long, bucket long, shared binary, hot binary, n long"))
    pieces = shared.agg(F.sum("n")).first()[0] or 0
    shards = max(cores, pieces * (length + 16) // SHARD_BYTES)

    mine = shared.groupBy("bundle").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("names"))
    cut = cut_lineage(bundles.select("bundle", "packed").join(mine, "bundle")
                      .mapInArrow(_cutter(length, gram, bits, shards), "bundle long, shard int, packed binary"))
    masks = cut.where("shard >= 0").groupBy("shard").applyInArrow(
        _sorter(length), "bundle long, shard int, packed binary")
    marks = (masks.union(cut.where("shard < 0")).groupBy("bundle")
             .agg(F.collect_list(F.struct("shard", "packed")).alias("rows")))
    return bundles.select("bundle", "packed").join(marks, "bundle", "left").select("packed", "rows").mapInArrow(
        _remover(length, pa.int64()),
        "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
