"""Near-duplicate groups: one-permutation MinHash, banded buckets, star edges.

A document's set holds its distinct word shingles. Equal sets collapse first,
by digest. Each remaining set is hashed once; the hashes fall into bins, ROWS for each of BANDS bands, and
the least of each bin is its signature value, an empty bin taking the value of
a full one by optimal densification. ROWS values make a band, and sets that
share a band share a bucket. A bucket compares its members with one centre, so
it gives as many candidate pairs as it has members. Where its other members then
still lie in several components, the next centre follows, a few times, and what
is left open is compared further (see _finish).
Every candidate pair is confirmed on full sets.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import prepare, text_bytes
from trackloom.session import Scope, cut_lineage

# A pair at 0.80 shares no band with probability (1 - 0.8 ** 7) ** 56 < 2e-6; one
# at 0.5 shares a given band with probability 0.008, which keeps passages that many
# documents share from filling buckets.
BANDS = 56
ROWS = 7
SHINGLE = 5
THRESHOLD = 80
# Centres that a bucket compares its members with before the exact filter takes
# what is then still open.
STARS = 4
# A centre that so many open sets are half like stands for their class: they meet by
# what they have otherwise than the centre.
CLASS = 16
# Words whose hashes a task remembers; the store is emptied when it is full.
REMEMBERED = 1 << 20

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: bytes, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text: A-Z lower-cased,
    words between ASCII blanks; with fewer words than ``width`` the whole
    sequence is one shingle; without words there is none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    take = min(width, len(ids))
    count = len(ids) - take + 1
    rolled = np.full(count, take, np.uint64)
    for k in range(take):
        rolled = _mix(rolled * _MIX[2] + ids[k:k + count])
    return np.unique(rolled)


def _detours(bins: int) -> np.ndarray:
    """For each bin, the bins to borrow from, in order: the same for all sets."""
    rng = np.random.default_rng(20_170_600)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(hashes: np.ndarray, detours: np.ndarray) -> np.ndarray:
    """Least hash of each bin; an empty bin takes that of the first full bin on
    its own list, which all sets share (optimal densification)."""
    bins = len(detours)
    mixed = _mix(hashes + _MIX[2])
    owner = (mixed >> np.uint64(32)) % np.uint64(bins)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner.astype(np.int64), _mix(mixed))
    full = np.zeros(bins, bool)
    full[owner.astype(np.int64)] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        first = full[detours[empty]].argmax(axis=1)
        least[empty] = least[detours[empty, first]]
    return least


def _band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    bands = least.reshape(-1, rows)
    keys = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        keys = _mix(keys * _MIX[2] + bands[:, k])
    return keys.view(np.int64)


def _sketcher(width: int, bands: int, rows: int):
    def run(batches):
        hashes, detours = WordHashes(), _detours(bands * rows)
        for batch in batches:
            counts, one, two, keys = [], [], [], []
            for text in text_bytes(batch):
                found = shingle_set(text, hashes, width)
                counts.append(len(found))
                mixed = _mix(found ^ _MIX[0])
                one.append(found.sum(dtype=np.uint64))
                two.append(mixed.sum(dtype=np.uint64))
                keys.append(_band_keys(signature(found, detours), rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()),
                pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
                pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "d1", "d2", "keys"])

    return run


def sketches(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set), keys (one per band)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _sketcher(width, bands, rows), f"doc_id {kind}, n_shingles long, d1 long, d2 long, keys array<long>")


def _setter(width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, hashes, width).tobytes() for text in text_bytes(batch)]
            part = [xxhash.xxh3_64_intdigest(x) >> 1 for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.int64()), pa.array(sets, pa.binary())],
                                             ["node", "part", "shingles"])

    return run


def _confirm(threshold: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, near = [], []
            for x, y in zip(left, right):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort(kind="stable")  # two sorted runs: a merge
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= threshold * (len(both) - shared))
                near.append(2 * shared >= len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_()), pa.array(near, pa.bool_())],
                                             ["a", "b", "linked", "close"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """a, b, linked and close (half of both shared) for every pair, by the full sets of
    both; a row for each two of their sets where a node has several."""
    kind = pairs.schema["a"].dataType.simpleString()
    held = (pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb"))
    return held.mapInArrow(_confirm(threshold), f"a {kind}, b {kind}, linked boolean, close boolean")


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) of every node of links (a, b).

    Each round hangs all neighbours of a node on the least of them, larger
    neighbours first and then smaller ones, until no link changes. Both are
    grouped minima and a join, so a hot node is never one task's list.
    """
    spark = links.sparkSession
    with Scope(spark) as scope:
        edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                            .where("u <> v").distinct())
        mark = None
        while True:
            old = [edges]
            both = edges.union(edges.select("v", "u")).toDF("u", "v")
            least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
            edges = (both.where("v > u").join(least, "u").select("v", "m").where("v <> m").distinct().toDF("u", "v"))
            edges = cut_lineage(edges)
            scope.drop(*old, least)
            old = [edges]
            least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))
            hung = edges.join(least, "u")
            edges = cut_lineage(hung.select("v", "m").where("v <> m").union(least.select("u", "m")).distinct().toDF("u", "v"))
            scope.drop(*old, least)
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == mark:
                return scope.keep(edges.groupBy("u").agg(F.min("v").alias("m"))
                                  .select(F.col("u").alias("node"), F.col("m").alias("component")))
            mark = now


def _tokens(batches):
    for batch in batches:
        found = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        if found:
            owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner),
                                              pa.array(np.concatenate(found))], ["node", "part", "token"])


def _rare_prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """bucket (a shingle), node, n, m, prefix: an exact filter for the sets that can link.

    n counts a set's shingles and m those of them that other sets have too. A set
    with m below the threshold's share of n links with nothing and goes. The
    others keep their rarest shared shingles, so many that two sets at the
    threshold have one of them in common (prefix filter).
    """
    kind = sets.schema["node"].dataType.simpleString()
    with Scope(sets.sparkSession) as scope:
        tokens = cut_lineage(sets.select("node", "part", "shingles").mapInArrow(_tokens, f"node {kind}, part long, token long"))
        shared = cut_lineage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
        least = F.ceil(F.col("n") * threshold / 100)
        held = (tokens.join(shared, "token").groupBy("node", "part")
                .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
                .withColumn("m", F.size("t").cast("long"))
                .join(sets.select("node", "part", (F.octet_length("shingles") / 8).cast("long").alias("n")), ["node", "part"])
                .where(F.col("m") * 100 >= F.col("n") * threshold))
        take = F.greatest((F.col("m") - least + 1).cast("int"), F.lit(0))
        prefix = F.transform(F.slice("t", F.lit(1), take), lambda x: x["token"])
        return scope.keep(held.select("node", "n", "m", prefix.alias("prefix")).withColumn("bucket", F.explode("prefix")))


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """bucket, node, n, component, main of the buckets that hold more than one
    component; main is the one with most members."""
    placed = cut_lineage(members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    shares = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    main = shares.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("k"))
    main = cut_lineage(main.where("k > 1").select("bucket", F.col("m.component").alias("main")))
    return placed.join(main, "bucket")


def _more_stars(members: DataFrame, tried: DataFrame, joined: DataFrame, sets: DataFrame,
                threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members whose pairs are not all settled, the pairs tried and the components.

    All pairs of a bucket's centre are tried, so it leaves the bucket, and a bucket
    whose other members share a component is settled. In the open ones the least
    member left is the next centre and meets the members of other components.
    """
    members = members.where("node <> centre").select("bucket", "node", "n")
    for _ in range(STARS - 1):
        with Scope(members.sparkSession) as scope:
            here = _open(members, joined)
            first = here.groupBy("bucket").agg(F.min(F.struct("node", "component")).alias("c"))
            star = cut_lineage(here.join(first, "bucket").select("bucket", "node", "n", "component", "c"))
            members = scope.keep(star.where("node <> c.node").select("bucket", "node", "n"))
            met = star.where("component <> c.component").select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
            fresh = cut_lineage(met.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
            if members.isEmpty():
                break
            found = scope.keep(confirmed(fresh, sets, threshold))
        tried = tried.union(found)
        if not found.where("linked").isEmpty():
            joined = components(tried.where("linked").select("a", "b"))
    return members, tried, joined


def _classes(tried: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, z: of the centres that an open set is close to, the one that most are."""
    near = tried.where("close").select(F.col("a").alias("z"), F.col("b").alias("node")).join(nodes, "node").select("z", "node").distinct()
    popular = cut_lineage(near.groupBy("z").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= CLASS))
    own = popular.select("z", F.col("z").alias("node")).join(nodes, "node").select("z", "node")
    return cut_lineage(near.union(own).join(popular, "z").groupBy("node").agg(F.max(F.struct("c", "z"))["z"].alias("z")))


def _differ(batches):
    for batch in batches:
        n, found = [], []
        for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            own = np.frombuffer(x, np.uint64)
            n.append(len(own))
            found.append(np.setxor1d(own, np.frombuffer(y, np.uint64), assume_unique=True).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                                         ["z", "node", "part", "n", "delta"])


def _difference_prefixes(classes: DataFrame, sets: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """An exact filter for the links inside a class; (members, pairs).

    With D the difference of a set to its class's centre, two sets differ in
    |Dx| + |Dy| - 2 |Dx and Dy| shingles, and link if that is at most
    (100 - threshold) / (100 + threshold) of the shingles of both. So they have
    some of D in common, but where both are so near the centre that they link
    whatever it is. Members meet at the rarest shingles of D, of which they keep
    as many as a link needs (bucket, node, slack, m, prefix, delta). Sets that are near enough
    for the other case link with the one that is nearest: those are the pairs.
    What all have in common is no longer met at, however alike the sets are.
    """
    kind = sets.schema["node"].dataType.simpleString()
    heads = (sets.join(classes.select(F.col("z").alias("node")).distinct(), "node")
             .groupBy("node").agg(F.min_by("shingles", "part").alias("sz")).withColumnRenamed("node", "z"))
    beside = sets.join(classes, "node").join(heads, "z").select("z", "node", "part", "shingles", "sz")
    slack = (100 - threshold) * F.col("n") - (100 + threshold) * F.size("delta")
    differing = cut_lineage(beside.mapInArrow(_differ, f"z {kind}, node {kind}, part long, n long, delta array<long>")
                            .withColumn("slack", slack.cast("long")))
    top = cut_lineage(differing.groupBy("z").agg(F.max(F.struct("slack", "node")).alias("top")))
    tokens = differing.select("z", "node", "part", F.explode("delta").alias("token"))
    shared = tokens.groupBy("z", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = (tokens.join(shared, ["z", "token"]).groupBy("z", "node", "part")
            .agg(F.sort_array(F.collect_list(F.struct("df", "token")))["token"].alias("delta"))
            .join(differing.select("z", "node", "part", "slack"), ["z", "node", "part"]).join(top, "z"))
    held = held.withColumn("m", F.size("delta").cast("long"))
    need = F.greatest(F.ceil(-(F.col("slack") + F.col("top.slack")) / (2 * (100 + threshold))), F.lit(1))
    take = F.greatest((F.col("m") - need + 1).cast("int"), F.lit(0))
    members = (held.withColumn("prefix", F.slice("delta", F.lit(1), take)).withColumn("token", F.explode("prefix"))
               .select(F.struct("z", "token").alias("bucket"), "node", "slack", "m", "prefix", "delta"))
    sure = differing.join(top, "z").where((F.col("slack") + F.col("top.slack") >= 0) & (F.col("node") != F.col("top.node")))
    return cut_lineage(members), cut_lineage(sure.select(F.col("top.node").alias("a"), F.col("node").alias("b")).distinct())


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs (a, b), the lesser node first, that were not tried either way round."""
    def ordered(rows):
        return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    return cut_lineage(ordered(pairs).distinct().join(ordered(tried), ["a", "b"], "left_anti"))


def _rounds(members: DataFrame, may_link, tried: DataFrame, joined: DataFrame, sets: DataFrame,
            threshold: int) -> tuple[DataFrame, DataFrame]:
    """The pairs tried and the components when no link of the buckets is open.

    Members outside a bucket's largest component become centres in turn, some of each
    bucket at first and more each round, and meet the members of other components
    that they may link with, until none is left. ``may_link`` sees the columns of
    both; the second's have an underscore in front.
    """
    done, at_once = members.select("bucket", "node").limit(0), 1024
    while True:
        with Scope(members.sparkSession) as scope:
            here = cut_lineage(_open(members, joined))
            loose = here.where("component <> main").join(done, ["bucket", "node"], "left_anti")
            rank = F.row_number().over(W.partitionBy("bucket").orderBy("node"))
            centres = scope.keep(loose.withColumn("_rank", rank).where(F.col("_rank") <= at_once).drop("_rank"))
            if centres.isEmpty():
                return tried, joined
            others = here.select("bucket", *[F.col(c).alias(f"_{c}") for c in here.columns if c != "bucket"])
            met = centres.join(others, "bucket").where((F.col("component") != F.col("_component")) & may_link)
            found = scope.keep(confirmed(_untried(met.select(F.col("node").alias("a"), F.col("_node").alias("b")), tried), sets, threshold))
        tried = tried.union(found)
        done = done.union(centres.select("bucket", "node"))
        at_once *= 16
        if not found.where("linked").isEmpty():
            joined = components(tried.where("linked").select("a", "b"))


def _finish(members: DataFrame, tried: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Components after the stars, with every link that the stars missed.

    Members of buckets that further centres leave open are dealt anew by
    their rare shingles, an exact filter that a shared passage does not pass.
    Those of one class are dealt by their differences to its centre instead, as
    many near copies below the threshold all have the same rare shingles. Pairs
    whose sizes, or counts of shingles that others share, rule a link out are not
    compared.
    """
    joined = components(tried.where("linked").select("a", "b"))
    members, tried, joined = _more_stars(members, tried, joined, sets, threshold)
    nodes = cut_lineage(_open(members, joined).select("node").distinct())
    if nodes.isEmpty():
        return joined
    members = _rare_prefixes(sets.join(nodes, "node"), threshold)
    classes = _classes(tried, members.select("node").distinct())
    # A pair meets once, at the first shingle that both prefixes have.
    first = F.get(F.array_intersect("prefix", "_prefix"), F.lit(0))
    if not classes.isEmpty():
        differing, sure = _difference_prefixes(classes, sets, threshold)
        tried = tried.union(cut_lineage(confirmed(_untried(sure, tried), sets, threshold)))
        joined = components(tried.where("linked").select("a", "b"))
        slack = F.col("slack") + F.col("_slack")

        def enough(common):
            return slack + 2 * (100 + threshold) * common >= 0

        tried, joined = _rounds(
            differing, enough(F.least("m", "_m")) & (first == F.col("bucket.token")) & enough(F.size(F.array_intersect("delta", "_delta"))),
            tried, joined, sets, threshold)
    most = F.least("m", "_m")
    size = 100 * most >= threshold * (F.col("n") + F.col("_n") - most)
    apart = F.coalesce(F.col("z") != F.col("_z"), F.lit(True))
    members = cut_lineage(members.join(classes, "node", "left"))
    return _rounds(members, apart & size & (first == F.col("bucket")), tried, joined, sets, threshold)[1]


def duplicate_groups(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE, bands: int = BANDS,
                     rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A and B| >= ``threshold`` * |A or B|.
    Null or blank texts have no shingles and are linked with nothing. Rows that
    share a doc_id are one document, which is linked with what any of them is. Rows without a doc_id stand for themselves
    only as copies of others; their own component is that of the set they hold,
    or null. An empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    with Scope(docs.sparkSession) as scope:
        return scope.keep(_groups(docs, threshold, width, bands, rows, scope))


def _groups(docs: DataFrame, threshold: int, width: int, bands: int, rows: int, scope: Scope) -> DataFrame:
    sketch = cut_lineage(sketches(docs, width, bands, rows))
    digest = ["d1", "d2", "n_shingles"]
    # Equal sets have equal keys: one row per distinct set, named by the least id.
    keyed = cut_lineage(sketch.where("n_shingles > 0").groupBy(*digest)
                        .agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")))
    groups = cut_lineage(keyed.select("node", *digest))
    labels = cut_lineage(sketch.drop("keys"))
    scope.drop(sketch)

    spread = (keyed.where("node is not null")
              .select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("bucket")))
    counted = spread.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members"))
    centres = cut_lineage(counted.where("members > 1").select("bucket", "centre"))
    members = cut_lineage(spread.join(centres, "bucket").select("bucket", "node", "n", "centre"))
    scope.drop(keyed, centres)
    pairs = cut_lineage(members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())

    # Sets of documents in buckets of two or more, written once for all rounds.
    candidates = cut_lineage(members.select("node").distinct())
    held = docs.select(F.col("doc_id").alias("node"), "text").join(candidates, "node")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = cut_lineage(held.mapInArrow(_setter(width), f"node {kind}, part long, shingles binary")
                       .dropDuplicates(["node", "part"]))

    tried = cut_lineage(confirmed(pairs, sets, threshold))
    joined = _finish(members, tried, sets, threshold)

    labelled = cut_lineage(groups.join(joined, "node", "left")
                           .select(*digest, F.coalesce("component", "node").alias("component_id")))
    return (labels.join(labelled, digest, "left")
            .withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents of which each group keeps its least doc_id, all columns as
    they were. Of repeated rows (equal doc_id) one stays; rows without a doc_id
    stay."""
    found = duplicate_groups(docs, **options)
    dropped = cut_lineage(found.where("not kept and doc_id is not null").select("doc_id").distinct())
    repeated = cut_lineage(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    rest = docs.join(dropped, "doc_id", "left_anti")
    if not repeated.isEmpty():
        once = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        rest = rest.join(repeated, "doc_id", "left_anti").unionByName(once)
    return rest.select(*docs.columns)
