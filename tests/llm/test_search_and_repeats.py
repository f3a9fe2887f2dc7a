"""Repeated bytes, hard negatives and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from trackloom.llm import hard_negatives, lexical_search, suffix_dedup

# Suffix arrays and repeated bytes.


def test_suffix_array_is_that_of_sorting():
    rng = random.Random(1)
    for _ in range(300):
        n, kinds = rng.randint(0, 80), rng.choice([1, 2, 3, 6, 300])
        text = [rng.randint(1, kinds) for _ in range(n)] + [0]
        if rng.random() < 0.3:
            text = (text[:-1][:4] * 20)[:60] + [0]
        found = suffix_dedup._suffix_array(np.array(text, np.uint16)).tolist()
        assert found == sorted(range(len(text)), key=lambda i: text[i:])


def test_least_owners_of_windows():
    rng = random.Random(2)
    for length in (3, 9, 20):
        for _ in range(60):
            pieces = list({bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(length, length + 30))) for _ in range(9)})
            owners = [rng.randint(-5, 5) for _ in pieces]
            for piece, found in zip(pieces, suffix_dedup.least_owners(pieces, owners, length)):
                assert found.tolist() == [min(o for x, o in zip(pieces, owners) if piece[k:k + length] in x)
                                          for k in range(len(piece) - length + 1)]


def plain_repeats(rows, length=50):
    """id -> (bytes, spans, kept) of rows (id, text) with different ids."""
    least = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(x for x in texts if x is not None):
        for k in range(len(texts[i]) - length + 1):
            least.setdefault(texts[i][k:k + length], i)
    out = {}
    for i, text in texts.items():
        gone = bytearray(len(text))
        for k in range(len(text) - length + 1) if i is not None else ():
            if least[text[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (len(text), spans, bytes(c for c, g in zip(text, gone) if not g))
    return out


def found_repeats(docs, **options):
    rows = suffix_dedup.remove_repeats(docs, **options).collect()
    return {r["doc_id"]: (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in rows}, len(rows)


def test_odd_repeats(spark, odd_docs, odd_texts, no_docs):
    found, count = found_repeats(odd_docs)
    plain = plain_repeats([*odd_texts.items(), (None, "no id here")])
    assert found == plain and count == odd_docs.count()
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_BUNDLES, 0])
def test_passages_and_copies(spark, monkeypatch, hot):
    """Passages of many lengths at any place, copies, a common line and periodic
    text, over many small bundles; with hot=0 every name is split by window."""
    rng = random.Random(3)
    monkeypatch.setattr(suffix_dedup, "BUNDLE_BYTES", 3000)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (30, 48, 49, 50, 51, 60, 120, 700)]
    line = "the same line of less than fifty bytes in all"
    texts = {}
    for i in rng.sample(range(10_000), 120):
        parts = [rng.choice([*passages, line, "z" * rng.randint(40, 90), str(rng.random()) * 3]) for _ in range(6)]
        texts[i] = "\n".join(parts)
    for i in rng.sample(sorted(texts), 30):
        texts[20_000 + i] = texts[i]
        texts[30_000 + i] = texts[i][:300] + "#" + texts[i][300:]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert found_repeats(docs, hot=hot)[0] == plain_repeats(texts.items())


def test_rows_that_share_an_id_keep_their_bytes(spark):
    text = "one passage that is longer than fifty bytes, as anyone can count"
    docs = spark.createDataFrame([(3, text), (3, text), (5, text), (None, text)], "doc_id long, text string")
    found = sorted(suffix_dedup.remove_repeats(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [bytes(r["kept"]) for r in found] == [text.encode(), text.encode(), b"", text.encode()]


# Hard negatives.


@pytest.mark.parametrize("low,high", [(-256, 256), (0, 1), (-3, 0), (10**6, 10**6 + 4), (-10**9, 10**9), (-2**62, 2**62), (5, 5)])
def test_packed_products_are_exact(low, high):
    rng = random.Random(4)
    for dims, many in ((1, 1), (7, 5), (64, 33), (3, 1100)):
        a = [[rng.randint(low, high) for _ in range(dims)] for _ in range(4)]
        c = [[rng.randint(low, high) for _ in range(dims)] for _ in range(many)]
        true = [[sum(x * y for x, y in zip(p, q)) for q in c] for p in a]
        most = 2**63 - 1
        found = hard_negatives.scores(np.array(a, object if high > 10**17 else np.int64), np.array(c, np.int64))
        assert found.tolist() == [[min(max(x, -most), most) for x in row] for row in true]


def plain_negatives(rows, step):
    """Of rows (id, label, vector), different ids."""
    held = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in held:
        if i % step:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in held if j != i and len(w) == len(v)]
        best = sorted(x for x in scored if x[2] == label)[:5]
        for p, j, _ in best:
            fits = sorted(x for x in scored if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


KIND = "vec_id long, label int, embedding array<double>, score string, ids int"


def test_negatives_of_clustered_and_odd_vectors(spark):
    rng = random.Random(5)
    rows, inf = [], float("inf")
    for i in range(400):
        label = rng.choice([1, 1, 1, 2, 3, 99])
        rows.append((i, label, [rng.gauss(label % 3, 1.0) for _ in range(6)], "clash", 1))
    rows += [(i, 1, rows[0][2], None, None) for i in range(1000, 1012)]  # ties
    rows += [(2000, 1, None, "", 1), (2001, None, [1.0] * 6, "", 1), (None, 1, [1.0] * 6, "", 1), (2050, 1, [1.0, None] * 3, "", 1),
             (2100, 1, [inf] * 6, "", 1), (2150, 1, [float("nan")] * 6, "", 1), (2200, 5, [0.0] * 6, "", 1), (2250, 6, [], "", 1),
             (2300, 7, [1.0, 2.0], "", 1), (2301, 7, [2.0, 2.0], "", 1), (2302, 8, [1.0, 1.0], "", 1)]
    table = spark.createDataFrame(rows, KIND).repartition(5)
    found = hard_negatives.hard_negatives(table, table.vec_id % 50 == 0)
    plain = plain_negatives([r[:3] for r in rows], 50)
    assert len(plain) > 50 and sorted(map(tuple, found.collect())) == plain
    doubled = hard_negatives.hard_negatives(table.union(table), table.vec_id % 50 == 0)
    assert sorted(map(tuple, doubled.collect())) == plain
    assert hard_negatives.hard_negatives(table.limit(0), table.vec_id % 50 == 0).count() == 0
    assert hard_negatives.hard_negatives(table, table.vec_id == -1).count() == 0


def test_negatives_in_many_cells(spark, monkeypatch):
    """A hot label over several blocks and cells gives the same as one block."""
    for name, value in (("CANDIDATES", 16), ("ANCHORS", 4), ("CELL_CANDIDATES", 2), ("CELL_ANCHORS", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(6)
    rows = [(i, 0 if i % 3 else i % 9, [rng.uniform(-1, 1) + (i % 9) / 9 for _ in range(5)], "", 0) for i in range(300)]
    table = spark.createDataFrame(rows, KIND).repartition(3)
    found = hard_negatives.hard_negatives(table, table.vec_id % 10 == 0)
    assert sorted(map(tuple, found.collect())) == plain_negatives([r[:3] for r in rows], 10)


# Ranked search.


def plain_search(rows, questions, top=10):
    """Of rows (id, text) with different ids; questions item -> text."""
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = {i: c for i, t in rows for c in [Counter(split(t))] if c}
    total, df = sum(sum(c.values()) for c in held.values()), Counter(t for c in held.values() for t in c)
    out = []
    for item, text in questions.items():
        scored = []
        for i, c in held.items():
            m = 25 + 75 * sum(c.values()) * len(held) // total
            score = sum(math.floor(1000 * math.log((2.0 * len(held) + 2) / (2.0 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in split(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if no else i, -s) for k, (s, no, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def test_bounds_give_the_plain_best():
    rng = random.Random(7)
    for _ in range(200):
        count, kinds = rng.randint(1, 2000), rng.randint(1, 12)
        lists, true = [], np.zeros(count, np.int64)
        for _ in range(kinds):
            docs = np.array(rng.sample(range(count), rng.randint(1, count)))
            gives = np.sort(np.array([rng.randint(0, rng.choice([1, 3, 1000])) for _ in docs]))[::-1]
            lists.append((docs, gives))
            true[docs] += gives
        ids = np.array(rng.sample(range(count), count))
        found, scores = lexical_search.best_by_bounds(lists, ids, count, 10)
        best = sorted((i for i in range(count) if true[i] > 0), key=lambda i: (-true[i], ids[i]))[:10]
        assert found.tolist() == best and scores.tolist() == true[best].tolist()


def test_reading_stops_early():
    """A list is not read on once nothing below can matter."""
    docs = np.arange(1_000_000)
    gives = np.concatenate((np.full(10, 1000), np.zeros(1_000_000 - 10, np.int64) + 1))

    class Watched(np.ndarray):
        most = 0

        def __getitem__(self, part):
            if isinstance(part, slice):
                Watched.most = max(Watched.most, part.stop)
            return np.asarray(self)[part]

    found, scores = lexical_search.best_by_bounds([(docs.view(Watched), gives)], docs, len(docs), 10)
    assert found.tolist() == list(range(10)) and Watched.most <= lexical_search.DEPTH


@pytest.mark.parametrize("postings", [lexical_search.SHARD_POSTINGS, 40])
def test_odd_search(spark, odd_docs, odd_texts, no_docs, monkeypatch, postings):
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", postings)
    asked = {1: None, 2: "", 3: "word1 word2 OTHER tail one", 4: "a a b c w x", 5: "élan 中文字符 DON'T", 6: "hello world", 7: "missing"}
    rows = [*asked.items(), (6, "hello world"), (4, "a a b c w x zz"), (4, None)]
    questions = spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")
    single = [*odd_texts.items(), (None, "no id here")]
    docs = odd_docs.where("doc_id is null").union(odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    found = sorted(map(tuple, lexical_search.search(docs, questions).collect()), key=str)
    assert found == plain_search(single, asked)
    assert lexical_search.search(no_docs, questions).count() == 0
    assert lexical_search.search(odd_docs, questions.limit(0)).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red fox"), (2, "red hen"), (3, "blue hen")], "doc_id long, text string")
    questions = spark.createDataFrame([(9, "fox")], "item_id long, text string")
    found = [tuple(r) for r in lexical_search.search(docs, questions).orderBy("rank").collect()]
    assert [r[:3] for r in found] == [(9, 1, 1), (9, 2, 1)] and found[0][3] == found[1][3]
