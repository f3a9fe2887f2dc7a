"""Byte-level BPE by Spark higher-order functions over distinct words.

A task meets its texts in order and numbers each distinct word once. The words
go through one column expression that folds ranked merges over their byte arrays.
The fold's state is the pieces of a word and the rank of each pair of neighbours;
a merge looks up only the two ranks beside it. The rank map is a literal of the
plan, in small buckets. Then the ids of the words are put in each text's order.
All of this is one stage without a shuffle; a task forgets its words whenever it
holds REMEMBERED of them, so its memory has a bound.
"""

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import prepare, texts

# Distinct chunks that a task holds; beyond that, numbering starts anew.
REMEMBERED = 1 << 18
# Words of more bytes merge all equal pairs in a step: taking out one pair at a
# time copies the state once a merge.
LONG = 2048
BUCKETS = 1 << 16
# Around each piece of a word while it is merged; no byte has these letters.
OPEN, CLOSE = "Ā", "ā"
# Rank of neighbours that have none.
NONE = (1 << 31) - 1
# Unicode white space.
SPACE = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """Literal array of BUCKETS maps from the letters of a token to its rank."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        letters = token.decode("latin-1")
        buckets[zlib.crc32(letters.encode()) % BUCKETS][letters] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def pair_map(ranks: dict[bytes, int]) -> tuple[Column, int]:
    """Literal map from two neighbours to the rank of their join, and its bucket mask.

    Bucket b has the ids r with their joins' ranks of all l and r that fall
    into it. _place is odd in l and there are more buckets than ids, so within a
    bucket r tells l.
    """
    mask = (1 << (max(ranks.values()) + 2).bit_length()) - 1
    keys: list[list[int]] = [[] for _ in range(mask + 1)]
    joins: list[list[int]] = [[] for _ in range(mask + 1)]
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                place = _place(left, right) & mask
                keys[place].append(right)
                joins[place].append(rank)
    singles = [ranks[bytes([b])] for b in range(256)]
    held = {"keys": keys, "joins": joins, "singles": singles}
    return F.from_json(F.lit(json.dumps(held)), "keys array<array<int>>, joins array<array<int>>, singles array<int>"), mask


def _place(left, right):
    """Bucket of two ids before its mask; below 2**31 for ids below 2**18."""
    return left * 7919 + right


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encoded(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ids to rows with word (byte letters) and bytes (its byte array): the
    word's own rank if it has one, else its merged bytes; null without a word."""
    letters, bytes_ = F.col("word"), F.col("bytes")
    own = F.element_at(F.get(rank_map(ranks), (F.crc32(letters) % BUCKETS).cast("int")), letters)
    pairs, mask = pair_map(ranks)
    ids = (F.when(letters.isNull(), F.lit(None)).when(F.col("_own").isNotNull(), F.array("_own"))
           .when(F.size(bytes_) > LONG, _bound(rank_map(ranks), lambda held: _merged_letters(letters, held)))
           .otherwise(_bound(pairs, lambda held: _merged(bytes_, held, mask))))
    return words.withColumn("_own", own).withColumn("ids", ids).drop("_own")


def _chained(*arrays: Column) -> Column:
    """concat, which costs more where it isn't compiled, as inside a fold."""
    return F.flatten(F.array(*arrays))


def _merged(bytes_: Column, pairs: Column, mask: int) -> Column:
    """Ids of a word given as its bytes. Each step merges the leftmost neighbours
    of least rank, until no neighbours have a rank.

    The state has an id of -1, which joins with nothing, at both ends, so that a
    merge always has neighbours; ranks[k] belongs to ids[k] and ids[k + 1].
    """
    def rank(left: Column, right: Column) -> Column:
        place = _place(left, right).bitwiseAND(F.lit(mask))
        at = F.array_position(F.get(pairs["keys"], place), right).cast("int") - 1
        return F.coalesce(F.get(F.get(pairs["joins"], place), at), F.lit(NONE))

    def start(ids: Column) -> Column:
        n = F.size(ids) - 1
        ranks = F.zip_with(F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n), rank)
        return F.struct(ids.alias("ids"), ranks.alias("ranks"))

    def step(held: Column, _: Column) -> Column:
        ids, ranks = held["ids"], held["ranks"]

        def merge(at: Column) -> Column:
            joined = F.get(ranks, at - 1)
            rest = F.size(ids)
            beside = F.array(rank(F.get(ids, at - 2), joined), rank(joined, F.get(ids, at + 1)))
            return F.when(joined == NONE, held).otherwise(F.struct(
                _chained(F.slice(ids, F.lit(1), at - 1), F.array(joined), F.slice(ids, at + 2, rest)).alias("ids"),
                _chained(F.slice(ranks, F.lit(1), at - 2), beside, F.slice(ranks, at + 2, rest)).alias("ranks")))

        return _bound(F.array_position(ranks, F.array_min(ranks)).cast("int"), merge)

    end = F.array(F.lit(-1))
    first = F.concat(end, F.transform(bytes_, lambda b: F.get(pairs["singles"], b)), end)
    return F.aggregate(F.sequence(F.lit(1), F.size(bytes_)), _bound(first, start), step,
                       lambda held: F.slice(held["ids"], F.lit(2), F.size(held["ids"]) - 2))


def _merged_letters(letters: Column, ranks: Column) -> Column:
    """Ids of a long word given in byte letters: each step merges the neighbours of
    least rank, all of that pair from the left, until no neighbours have a rank."""

    def rank(x: Column) -> Column:
        return F.element_at(F.get(ranks, (F.crc32(x) % BUCKETS).cast("int")), x)

    def parts(state: Column) -> Column:
        return F.split(F.substring(state, F.lit(2), F.length(state) - 2), CLOSE + OPEN)

    def best(pieces: Column) -> Column:
        return F.array_min(F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda a, b: F.struct(
            F.coalesce(rank(F.concat(a, b)), F.lit(NONE)).alias("r"), a.alias("a"), b.alias("b"))))

    def step(held: Column, _: Column) -> Column:
        def merge(pair: Column) -> Column:
            joined = F.replace(held["s"], F.concat(F.lit(OPEN), pair["a"], F.lit(CLOSE + OPEN), pair["b"], F.lit(CLOSE)),
                               F.concat(F.lit(OPEN), pair["a"], pair["b"], F.lit(CLOSE)))
            return F.when(pair["r"] == NONE, F.struct(held["s"].alias("s"), F.lit(True).alias("done"))).otherwise(
                F.struct(joined.alias("s"), F.lit(False).alias("done")))

        return F.when(held["done"], held).otherwise(_bound(best(parts(held["s"])), merge))

    start = F.struct(F.regexp_replace(letters, "(?s)(.)", f"{OPEN}$1{CLOSE}").alias("s"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.length(letters)), start, step, lambda held: F.transform(parts(held["s"]), rank))


def _numberer(pattern: str):
    coarse = regex.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    words_of = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))

    def run(batches):
        chunks: dict[str, bytes] = {}
        words: dict[str, int] = {}
        for batch in batches:
            refs, fresh, reset = [], [], len(chunks) > REMEMBERED
            if reset:
                chunks.clear()
                words.clear()
            for text in texts(batch):
                found = coarse.findall(text)
                for chunk in found:
                    if chunk not in chunks:
                        numbers = []
                        for word in words_of.findall(chunk):
                            number = words.get(word)
                            if number is None:
                                number = words[word] = len(words)
                                fresh.append(word.encode())
                            numbers.append(number)
                        chunks[chunk] = np.array(numbers, "<i4").tobytes()
                refs.append(b"".join(map(chunks.__getitem__, found)))
            kind = batch.column(0).type
            if reset:
                yield _message(pa.nulls(1, kind), [None], [None])
            if fresh:
                yield _message(pa.nulls(len(fresh), kind), [None] * len(fresh), fresh)
            yield _message(batch.column(0), refs, [None] * len(refs))

    return run


def _message(ids: pa.Array, refs: list, words: list) -> pa.RecordBatch:
    """Rows for texts (refs), for fresh words, or, without either, to forget all words."""
    ends = np.cumsum([0, *(len(word or b"") for word in words)], dtype=np.int32)
    flat = np.frombuffer(b"".join(word or b"" for word in words), np.uint8).astype(np.int32)
    letters = [None if word is None else word.decode("latin-1") for word in words]
    return pa.RecordBatch.from_arrays([ids, pa.array(refs, pa.binary()), pa.array(letters, pa.string()),
                                       pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                      ["doc_id", "refs", "word", "bytes"])


def _gather(path: str | None = None):
    """Ids of each text; with a rank file, also their bytes."""
    def run(batches):
        by_rank = {rank: token for token, rank in read_ranks(path).items()} if path else {}
        table: list[bytes] = []
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4") if len(lists) else np.empty(0, "<u4")
            owner, out, at = [], [], 0
            for row, (refs, size) in enumerate(zip(batch.column(1).to_pylist(), lists.value_lengths().to_pylist())):
                if refs is not None:
                    owner.append(row)
                    out.append(b"".join(map(table.__getitem__, np.frombuffer(refs, "<i4").tolist())))
                elif size is None:
                    table.clear()
                else:
                    table.append(flat[at:at + size].tobytes())
                    at += size
            if owner:
                found = [batch.column(0).take(pa.array(owner)), pa.array(out, pa.binary())]
                names = ["doc_id", "ids"]
                if path:
                    found.append(_pieces(out, by_rank))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(found, names)

    return run


def _pieces(ids: list[bytes | None], by_rank: dict[int, bytes]) -> pa.Array:
    """The bytes of the ids of each row, one after the other."""
    return pa.array([None if raw is None else b"".join(map(by_rank.__getitem__, np.frombuffer(raw, "<u4").tolist()))
                     for raw in ids], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every row.

    ``pattern`` splits a text into words, which are encoded separately; it must
    treat a single space before a word as ``PATTERN`` of public byte-level
    vocabularies does. A null text has no ids; repeated rows, null ids and other
    columns change nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _found(docs, path, pattern).mapInArrow(_gather(), f"doc_id {kind}, ids binary")


def _found(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and refs (numbers of words) of each text, and before them the ids of
    the words that are new to the task."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", "text").mapInArrow(
        _numberer(pattern), f"doc_id {kind}, refs binary, word string, bytes array<int>")
    return encoded(numbered, read_ranks(path)).select("doc_id", "refs", "ids")


def _decoder(path: str):
    def run(batches):
        by_rank = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _pieces(batch.column(1).to_pylist(), by_rank)],
                                             ["doc_id", "ids", "decoded"])

    return run


def decode(encoded_docs: DataFrame, path: str) -> DataFrame:
    """Adds decoded (binary): the bytes of each row's ids, one after the other."""
    kind = encoded_docs.schema["doc_id"].dataType.simpleString()
    return encoded_docs.select("doc_id", "ids").mapInArrow(_decoder(path), f"doc_id {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ids are decoded in
    the worker that puts them in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = _found(docs, path, pattern).mapInArrow(_gather(path), f"doc_id {kind}, ids binary, decoded binary")
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
