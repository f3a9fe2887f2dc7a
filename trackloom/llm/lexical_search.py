"""Ranked lexical search: exact top documents of every question, without random access.

Each document gives its terms with their counts once; the terms that questions hold
become postings with an integer impact, dealt into shards by document. A shard sorts
its lists by impact and answers each question by NRA: it reads the lists of the
question's terms from the top, all to the same depth, and keeps for each document the
sum of what was read (lower bound) and that plus the next unread impact of every other
list (upper bound). It stops when no document outside can enter, and all that still
could are read to the end of what they can get; their scores are then final, and ties
go by id. The best of the shards are merged.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import prepare, text_bytes
from trackloom.session import cut_lineage

TOP = 10
# Postings of a shard and questions of a block, as sizes to aim at.
SHARD_POSTINGS = 1_000_000
QUESTIONS = 1024
DEPTH = 128  # entries read of each list at first; each further read doubles what was read

# ASCII that is no letter or digit parts terms; A-Z become a-z. Other bytes stay.
_TABLE = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or 48 <= k <= 57 or k > 127 else 32 for k in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _counter(batches):
    """row (unique), the key column, n, terms, counts of each row of (key, text)."""
    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        found = [Counter(terms(x)) for x in text_bytes(batch)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(at, at + len(found)), pa.int64()), batch.column(0),
             pa.array([sum(x.values()) for x in found], pa.int64()),
             pa.array([list(x) for x in found], pa.list_(pa.binary())),
             pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], ["row", "key", "n", "terms", "counts"])
        at += len(found)


def _counted(rows: DataFrame) -> DataFrame:
    """Of a table (key long, text)."""
    return cut_lineage(rows.mapInArrow(_counter, "row long, key long, n long, terms array<binary>, counts array<int>"))


def best_by_bounds(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, count: int, top: int):
    """The best ``top`` documents and their scores from impact-sorted lists.

    A list has document numbers below ``count`` and contributions, greatest first.
    Equal scores go by ``ids``. Documents without a contribution above 0 don't count.
    """
    lower, seen = np.zeros(count, np.int64), np.zeros((count, len(lists)), bool)
    read, depth = [0] * len(lists), DEPTH
    while True:
        ahead = np.zeros(len(lists), np.int64)  # the most that a list's unread part gives
        for k, (docs, gives) in enumerate(lists):
            part = docs[read[k]:depth]
            lower[part] += gives[read[k]:depth]
            seen[part, k] = True
            read[k] = min(depth, len(docs))
            ahead[k] = gives[read[k]] if read[k] < len(docs) else 0
        rest = int(ahead.sum())
        met = np.flatnonzero(lower)
        least = int(np.partition(lower[met], len(met) - top)[len(met) - top]) if len(met) >= top else 0
        if rest == 0 or rest < least:
            open_ = met[lower[met] + rest >= least]
            missing = rest - seen[open_].astype(np.int64) @ ahead if rest else np.zeros(len(open_), np.int64)
            could = lower[open_] + missing >= least
            if not missing[could].any():
                final = open_[could]
                final = final[np.lexsort((ids[final], -lower[final]))][:top]
                return final, lower[final]
        depth *= 2


def _answerer(top: int):
    def run(postings: pa.Table, questions: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if postings.num_rows and questions.num_rows:
            row, term, impact = (postings.column(c).to_numpy() for c in ("row", "term", "impact"))
            order = np.lexsort((-impact, term))
            row, term, impact = row[order], term[order], impact[order]
            rows, first, doc = np.unique(row, return_index=True, return_inverse=True)
            keys = postings.column("key").combine_chunks().take(pa.array(order[first]))
            known = np.asarray(keys.is_valid())
            # Rows without an id come last among equals; equal ids by row.
            ids = np.empty(len(rows), np.int64)
            ids[np.lexsort((rows, np.asarray(keys.fill_null(0)), ~known))] = np.arange(len(rows))
            heads = np.flatnonzero(np.diff(term, prepend=-1))
            place = dict(zip(term[heads].tolist(), zip(heads.tolist(), [*heads[1:].tolist(), len(term)])))
            names = keys.to_pylist()
            for question, asked in zip(questions.column("question").to_pylist(), questions.column("asked").to_pylist()):
                lists = []
                for x in asked:
                    if x["term"] in place:
                        s, e = place[x["term"]]
                        lists.append((doc[s:e], impact[s:e] * x["weight"]))
                if lists:
                    found, scores = best_by_bounds(lists, ids, len(rows), top)
                    out[0].extend([question] * len(found))
                    out[1].extend(names[k] for k in found)
                    out[2].extend(rows[found].tolist())
                    out[3].extend(scores.tolist())
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["question", "key", "row", "score"])

    return run


def search(docs: DataFrame, questions: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each question.

    ``docs`` has doc_id and text, ``questions`` item_id and text. Scores are those of
    BM25 in integers: a term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))), a
    document gives it (10^9 tf) div (1000 tf + 8 m) times with
    m = 25 + (75 n N) div L, and each occurrence in the question counts. Only scores
    above 0 come; equal ones go by the smaller doc_id, rows without one last.

    Null and empty texts hold no term: such documents don't count, such questions have
    no result. Rows that share a doc_id are documents of their own. Of questions that
    share an item_id the one with the least text stands. Empty tables give an empty
    result; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    counted = _counted(docs.select(F.col("doc_id").cast("long").alias("key"), "text"))
    single = questions.groupBy(F.col("item_id").cast("long").alias("key")).agg(F.min("text").alias("text"))
    items = _counted(single)
    asked = items.select(F.col("row").alias("question"), F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    asked = asked.select("question", F.col("x.terms").alias("word"), F.col("x.counts").alias("times"))
    size, length = counted.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()

    words = cut_lineage(asked.select("word").distinct())
    held = (counted.select("row", "key", "n", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
            .select("row", "key", "n", F.col("x.terms").alias("word"), F.col("x.counts").alias("tf")).join(words, "word"))
    held = cut_lineage(held)
    ratio = F.lit(2.0 * size + 2) / (F.lit(2.0) * F.col("df") + F.lit(1.0))
    weights = held.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select(
        "word", F.floor(F.lit(1000.0) * F.log(ratio)).alias("w")).where("w > 0")
    weights = cut_lineage(weights.withColumn("term", F.monotonically_increasing_id()))

    shards = max(spark.sparkContext.defaultParallelism, held.count() // SHARD_POSTINGS + 1)
    blocks = items.count() // QUESTIONS + 1
    share = F.expr(f"cast((cast(75 * n as decimal(19,0)) * {size}) div {length or 1} as long)")
    impact = F.expr("(1000000000 * cast(tf as long)) div (1000 * cast(tf as long) + 8 * (25 + share))")
    lists = (held.join(weights.select("word", "term"), "word").withColumn("share", share)
             .select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"),
                     F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "row", "key", "term", impact.alias("impact")))
    given = (asked.join(weights, "word").groupBy("question")
             .agg(F.collect_list(F.struct("term", (F.col("w") * F.col("times")).alias("weight"))).alias("asked"))
             .select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                     F.pmod(F.xxhash64("question"), F.lit(blocks)).cast("int").alias("block"), "question", "asked"))
    found = (lists.groupBy("shard", "block").cogroup(given.groupBy("shard", "block"))
             .applyInArrow(_answerer(top), "question long, key long, row long, score long"))
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return (ranked.join(items.select(F.col("row").alias("question"), F.col("key").alias("item_id")), "question")
            .select("item_id", "rank", F.col("key").alias("doc_id"), "score"))
