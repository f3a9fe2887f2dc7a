"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (a line with a word) is hashed to a wide vector: four 64-bit
numbers from its bytes, and LANES 16-bit counters to which its word triples add
one or take one. A fingerprint is the sum of the vectors, modulo 2**64 and 2**16.
The order of paragraphs does not matter, and a paragraph is put in or taken out
by adding or subtracting its vector. Equality rests on the wide numbers, likeness
on the angle between the counters.
"""

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import prepare, texts
from trackloom.llm.near_dedup import WordHashes, _mix
from trackloom.session import cut_lineage

LANES = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Fingerprint:
    """Sum of paragraph vectors."""

    __slots__ = ("wide", "lanes")

    def __init__(self, wide: np.ndarray | None = None, lanes: np.ndarray | None = None):
        self.wide = np.zeros(4, np.uint64) if wide is None else wide
        self.lanes = np.zeros(LANES, np.int16) if lanes is None else lanes

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.wide + other.wide, self.lanes + other.lanes)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.wide - other.wide, self.lanes - other.lanes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.wide == other.wide).all())

    __hash__ = None

    def hex(self) -> str:
        return self.wide.astype(">u8").tobytes().hex() + self.lanes.astype(">i2").tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> "Fingerprint":
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[:32], ">u8").astype(np.uint64), np.frombuffer(raw[32:], ">i2").astype(np.int16))

    def likeness(self, other: "Fingerprint") -> float:
        """1 for equal ones, else the cosine of the counters, not below 0."""
        if self == other:
            return 1.0
        a, b = self.lanes.astype(np.float64), other.lanes.astype(np.float64)
        size = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / size)) if size else 0.0


def of_text(text: str, words: WordHashes) -> Fingerprint:
    """Fingerprint of the paragraphs of a text."""
    lines = [line for line in text.encode("utf-8").split(b"\n") if line and not line.isspace()]
    if not lines:
        return Fingerprint()
    one = np.frombuffer(b"".join([xxhash.xxh3_128_digest(line, 1) for line in lines]), "<u8").reshape(-1, 2)
    two = np.frombuffer(b"".join([xxhash.xxh3_128_digest(line, 2) for line in lines]), "<u8").reshape(-1, 2)
    split = [line.split() for line in lines]
    sizes = np.array([len(s) for s in split])
    flat = np.fromiter((words[w] for s in split for w in s), np.uint64, int(sizes.sum()))
    # Triples that start in a line and end in the same one; a shorter line is one triple.
    last = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(flat))
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded = np.concatenate([flat, np.zeros(2, np.uint64)])
    second = np.where(at + 1 < last, padded[1:len(flat) + 1], np.uint64(0))
    third = np.where(at + 2 < last, padded[2:len(flat) + 2], np.uint64(0))
    mixed = _mix(_mix(_mix(flat + _STEP) + second) + third)
    mixed = mixed[(at + 2 < last) | (at == begins)]
    sign = 1.0 - 2.0 * ((mixed >> np.uint64(7)) & np.uint64(1)).astype(np.float64)
    lanes = np.bincount((mixed & np.uint64(LANES - 1)).astype(np.int64), weights=sign, minlength=LANES)
    return Fingerprint(np.concatenate([one.sum(0, dtype=np.uint64), two.sum(0, dtype=np.uint64)]),
                       lanes.astype(np.int64).astype(np.int16))


def edited(text: str, following: str) -> tuple[str, int]:
    """Text whose last third is replaced by as much of ``following``, and where the
    paragraph starts in which the cut lies."""
    size = len(text) // 3
    cut = len(text) - size
    return text[:cut] + following[:size], text.rfind("\n", 0, cut) + 1


def _compared(text: str, print_: Fingerprint, following: str, next_print: Fingerprint, words: WordHashes) -> tuple:
    """The edited text's fingerprint is updated, not made anew: the paragraphs from
    the cut on are taken out and the new ones put in."""
    new, start = edited(text, following)
    changed = print_ - of_text(text[start:], words) + of_text(new[start:], words)
    return (len(text), sha256(new.encode()).hexdigest(), print_.hex(), changed.hex(), print_.likeness(changed),
            print_.likeness(next_print))


_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double")


def _walk(batches):
    """Rows of a sorted partition: each is compared with the next; the first is also
    given as a head, the last as a tail (role 1 and 2), with their texts."""
    words, part = WordHashes(), TaskContext.get().partitionId()
    held = None  # id (an array of one), text, fingerprint
    for batch in batches:
        ids, done, roles, keep = [], [], [], []

        def give(owner, role, text, values):
            ids.append(owner)
            roles.append(role)
            keep.append(text)
            done.append(values or (None,) * len(_FIELDS))

        column = batch.column(0)
        for at, text in enumerate(texts(batch)):
            made = of_text(text, words)
            owner = column.slice(at, 1)
            if held is None:
                give(owner, 1, text, None)
            else:
                give(held[0], 0, None, _compared(held[1], held[2], text, made, words))
            held = (owner, text, made)
        if ids:
            yield _batch(ids, done, part, roles, keep)
    if held is not None:
        yield _batch([held[0]], [(None,) * len(_FIELDS)], part, [2], [held[1]])


def _batch(ids, done, part, roles, keep):
    columns = [pa.array([d[k] for d in done], kind) for k, (_, kind) in enumerate(_FIELDS)]
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays(ids), *columns, pa.array([part] * len(roles), pa.int32()), pa.array(roles, pa.int32()),
         pa.array(keep, pa.string())], ["doc_id", *[n for n, _ in _FIELDS], "part", "role", "text"])


def _close(batches):
    words = WordHashes()
    for batch in batches:
        rows = [_compared(a, of_text(a, words), b, of_text(b, words), words)
                for a, b in zip(texts(batch, "text"), texts(batch, "following"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_FIELDS)]],
            ["doc_id", *[n for n, _ in _FIELDS]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of every row.

    The next document is the one below in descending doc_id (nulls last; equal ids
    by a hash of their texts), after the last the first. Rows are dealt out by
    range, so a task has neighbours beside each other; only the first and last row
    of each task meet in a join. A null text is empty; a table of one row has
    itself as the next; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = cut_lineage(dealt.mapInArrow(_walk, f"doc_id {kind}, {_DDL}, part int, role int, text string"))
    names = ["doc_id", *[n for n, _ in _FIELDS]]
    # One number per task: which task's head follows which task's tail.
    parts = [r["part"] for r in walked.where("role = 1").select("part").orderBy("part").collect()]
    if not parts:
        return walked.select(*names)
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    heads = walked.where("role = 1").select(F.col("part").alias("after"), F.col("text").alias("following"))
    tails = walked.where("role = 2").select("part", "doc_id", "text").join(follows, "part").join(heads, "after")
    closed = tails.select("doc_id", "text", "following").mapInArrow(_close, f"doc_id {kind}, {_DDL}")
    return walked.where("role = 0").select(*names).unionByName(closed)
