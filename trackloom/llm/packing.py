"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces of at most CAPACITY tokens. Full pieces are sequences of
their own; the others are dealt to groups of bounded size, each packed by
best-fit decreasing in one task. Dual-feasible functions give a lower bound of a
group's bin count, and a group that meets it keeps its bins. The emptiest bins
of all others, and the last bin of each, go back: their pieces meet in fewer
groups and are packed again, until one group is left.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import prepare, text_bytes
from trackloom.llm.word_bpe import ChunkIds
from trackloom.session import cut_lineage

CAPACITY = 2048
# Pieces of a group, about; a group is packed in the memory of one task.
GROUP = 100_000
# A group of the next round takes the pieces that so many groups give back: those of
# 1 + 8 * gap bins each, for a gap of that many bins to the bound.
MERGED = 16


def _cutter(path: str, capacity: int, closing: int):
    def run(batches):
        chunks, end = ChunkIds(path), closing.to_bytes(4, "little")
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for at, raw in enumerate(chunks.encode(text_bytes(batch))):
                raw += end
                for k, low in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[low:low + 4 * capacity]
                    owner.append(at)
                    piece.append(k)
                    start.append(low // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the closing id,
    in pieces of ``capacity``; the last may be shorter. A null text is empty and
    still has its closing id."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _cutter(path, capacity, closing), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, longest first into the fullest bin that has
    room, and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: a bin has room r
    for at, size in zip(np.argsort(-lengths, kind="stable").tolist(), np.sort(-lengths, kind="stable").tolist()):
        size = -size
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, held, count = capacity, count, count + 1
        bins[at], offsets[at] = held, capacity - room
        left = room - size
        if left:
            by_room[left].append(held)
            rooms |= 1 << left
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible
    functions, which are: count items above capacity - a as whole bins and leave out
    those below a; and round multiples, (k + 1) x to its floor over k."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    total = np.cumsum(counts * sizes)
    number = np.cumsum(counts)
    best = -(-int(total[-1]) // capacity)
    a = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - a]
    middle = total[capacity - a] - total[a - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        value = np.where(exact, k * scaled, (scaled // capacity) * capacity * (k + 1))  # over capacity * k * (k + 1)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k * (k + 1))))
    return best


def _packer(capacity: int, turn: int, last: bool):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table.column("length").to_numpy()
        bins, offsets, count = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        back = np.zeros(count, bool)
        if not last:
            fill = np.bincount(bins, weights=lengths, minlength=count)
            back[np.argsort(fill, kind="stable")[:1 + 8 * (count - bound)]] = True
        first = ((turn << 22) + TaskContext.get().partitionId()) << 34
        for low in range(0, len(lengths), 10_000):
            some = slice(low, low + 10_000)
            part = table.slice(low, 10_000).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(bins[some] + first), pa.array(offsets[some]),
                 pa.array(np.full(part.num_rows, count == bound)), pa.array(back[bins[some]])],
                [*part.schema.names, "sequence_id", "offset", "certified", "_back"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, merged: int = MERGED) -> DataFrame:
    """Adds sequence_id, offset and certified to pieces (columns doc_id, piece,
    start, length, ids_crc32). certified: the bins of its last group, or its own full
    sequence, are as few as can be. Equal rows are packed as often as they occur.
    """
    items = cut_lineage(items)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = items.where(F.col("length") == capacity).select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(True).alias("certified"))
    rest = items.where(F.col("length") < capacity).select(*names)
    groups, turn, done = -(-rest.count() // group), 0, [alone]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema) + (
        ", sequence_id long, offset long, certified boolean, _back boolean")
    while groups:
        last = groups == 1
        dealt = rest.repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)))
        tried = cut_lineage(dealt.mapInArrow(_packer(capacity, turn, last), schema))
        done.append(tried.where("not _back").drop("_back"))
        rest, turn, groups = tried.where("_back").select(*names), turn + 1, 0 if last else -(-groups // merged)
    packed = done[0]
    for part in done[1:]:
        packed = packed.unionByName(part)
    return packed


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0, **options) -> DataFrame:
    """One row per piece of every document, with its place in a sequence. An empty
    table gives an empty result; other columns are not read; ids may be null."""
    return pack(pieces(docs, path, capacity, closing), capacity, **options)
