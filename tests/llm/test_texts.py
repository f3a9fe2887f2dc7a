"""Whole-text operators against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm import byte_bpe, common, fingerprints, license_scan, packing, pii, quality_rules, queries, secret_scan, token_counts

BLANK = r"[\x20\x09-\x0D]"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def some_docs(spark, odd_docs):
    """The awkward texts and a table's."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    return odd_docs.select("doc_id", "text").unionByName(table)


@pytest.fixture(scope="module")
def plain(some_docs):
    return {r["doc_id"]: r["text"] or "" for r in some_docs.collect()}


def plain_statistics(text):
    words = [w for w in re.split(BLANK + "+", text) if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1 if len(windows) < 3000 else w in windows[:i] or w in windows[i + 1:i + 9000]:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(f"[^{BLANK[1:-1]}]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered))


def test_statistics(some_docs, plain):
    found = by_id(quality_rules.text_statistics(some_docs, "doc_id"))
    for i, text in plain.items():
        if len(text) < 40_000:
            assert tuple(found[i][c] for c in quality_rules.BASE) == plain_statistics(text), i


def test_decision_list(spark):
    """A planted conjunction is learned, held-out rows are told apart, and no label gives no rule."""
    rows = [(k, ("!! " if k % 4 == 0 else "") + " ".join(f"{'BAD!!' if k % 4 == 0 else 'fine'}{j}" for j in range(60 + k % 7)))
            for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.where("doc_id < 600").select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    found = by_id(quality_rules.judged(docs, labels))
    assert all(found[k]["kept"] == (k % 4 != 0) for k in range(600, 800))
    assert all(r["kept"] for r in quality_rules.judged(docs, labels.limit(0)).collect())
    assert quality_rules.keep_good(docs, labels).columns == docs.columns


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_patterns(plain):
    for i, text in plain.items():
        assert pii.base_spans(text) == plain_pii(text), i
    rng = np.random.default_rng(3)
    for _ in range(4000):
        text = "".join(rng.choice(list("ab1.@+- 4()%_0")) for _ in range(rng.integers(1, 30)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_pii_contexts(spark, odd_docs, no_docs):
    """Contexts that seeds prove discover an identifier no pattern has; others do not."""
    rows = [(k, f"please reach me at user{k}@mail.example.com today") for k in range(60)]
    rows += [(100, "please reach me at 77-1234-99 today"), (101, "lot number is 77-1234-98 today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(pii.scan(docs))
    assert [s["kind"] for s in found[100]["spans"]] == ["context"] and found[101]["spans"] == []
    changed = by_id(pii.mask(odd_docs))
    assert changed[1]["text"] is None and "<email>" in changed[11]["text"] and changed[11]["_key"] == "clash"
    assert pii.mask(odd_docs).columns == odd_docs.columns and pii.scan(no_docs).count() == 0
    masked = by_id(pii.mask(docs))
    assert masked[0]["text"] == "please reach me at <email> today"


def test_pii_few_seeds(spark):
    """Five to thirty seeds prove a context, four do not; unseen instances are no evidence against it; shapes pool seeds."""
    rows, k, unseen = [], 0, {}
    for seeds, others in ((4, 1), (5, 1), (20, 1), (30, 1), (6, 6), (10, 60)):
        rows += [(k + j, f"some words kind{chr(97 + len(unseen))} contact user{k + j}@mail.example.com today") for j in range(seeds)]
        k += seeds
        rows += [(k + j, f"some words kind{chr(97 + len(unseen))} contact 77-{k + j}-9911 today") for j in range(others)]
        unseen[seeds] = range(k, k + others)
        k += others
    rows += [(k + j, f"see (ticket{j}: user{k + j}@mail.example.com, then row {j} user{k + j}@mail.example.com") for j in range(5)]
    k += 5
    rows += [(k, "see ticket99: 88-1234-99 end"), (k + 1, "one row 99 88-1234-98 end")]
    found = by_id(pii.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for seeds, ids in unseen.items():
        assert all([s["kind"] for s in found[i]["spans"]] == ["context"] * (seeds >= pii.SEEDS) for i in ids), seeds
    assert [s["kind"] for i in (k, k + 1) for s in found[i]["spans"]] == ["context", "context"]


def test_pii_proved_contexts_prove_others(spark):
    """Identifiers that a proved context discovers prove a context of few seeds."""
    rows = [(k, f"some good contact user{k}@mail.example.com today") for k in range(40)]
    rows += [(100 + k, f"some good contact 77-{k}00-9911 today") for k in range(12)]
    rows += [(200 + k, f"other words callback 77-{k}00-9911 today") for k in range(12)]
    rows += [(300, "other words callback user500@mail.example.com today"), (301, "other words callback 88-4321-77 today"),
             (302, "never proved place 88-4321-78 today")]
    found = by_id(pii.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [s["kind"] for s in found[301]["spans"]] == ["context"] and found[302]["spans"] == []


def test_pii_chance_seeds_prove_nothing(spark):
    """A frequent context with a few seeds by chance reports none of its numbers."""
    rows = [(k, f"many words of the user{k}@mail.example.com today") for k in range(5)]
    rows += [(100 + k, f"many words of the {10_000 + k} things") for k in range(3000)]
    rows += [(9000 + k, f"many words my contact user{k}@mail.example.com today") for k in range(20)]
    rows += [(9100 + k, f"many words my contact 77-{k}-9911 today") for k in range(10)]
    found = by_id(pii.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(found[100 + k]["spans"] == [] for k in range(3000))
    assert all([s["kind"] for s in found[9100 + k]["spans"]] == ["context"] for k in range(10))


def test_sample_shares_never_vanish(spark):
    rows = spark.range(1000)
    assert 350 < common.sampled(rows, "id", 500, 1000).count() < 650 and common.sampled(rows, "id", 5000, 1000).count() == 1000
    bound = common.sampled(rows, "id", 30_000, 10**11)._jdf.queryExecution().analyzed().toString()
    assert "< 1383505805528" in bound  # 2^62 * 3e-7


def test_pii_fixed_point(spark):
    """Scores are those that plain rounds tend to."""
    rng = np.random.default_rng(5)
    edges = {(f"c{c}", f"i{c}s{j}"): True for c in range(8) for j in range(int(rng.integers(3, 40)))}
    for _ in range(120):
        edges[f"c{rng.integers(8)}", f"u{rng.integers(40)}"] = False
    proved = {c: sum(s for (d, _), s in edges.items() if d == c) for c in {c for c, _ in edges}}
    score = {c: 0.0 for c, n in proved.items() if n >= pii.SEEDS}
    held = [(c, i, s) for (c, i), s in edges.items() if c in score]
    for _ in range(3000):
        best = {}
        for c, i, s in held:
            best[i] = max(best.get(i, 0.0), score[c])
        score = {c: (sum(1.0 if s else best[i] for d, i, s in held if d == c) + 1) / (sum(d == c for d, _, _ in held) + 3) for c in score}
    found = pii.context_scores(spark.createDataFrame([(c, i, s) for (c, i), s in edges.items()], "context string, instance string, seed boolean"))
    assert {r["context"]: round(r["score"], 6) for r in found.collect()} == {c: round(x, 6) for c, x in score.items()}


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
        r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32])


def test_secret_patterns(odd_docs, no_docs, plain):
    for i, text in plain.items():
        assert secret_scan.base_spans(text) == plain_secrets(text), i
    found = by_id(secret_scan.scan(odd_docs))
    assert [s["kind"] for s in found[13]["spans"]][:2] == ["assign", "assign"] and found[1]["spans"] == []
    assert secret_scan.scan(no_docs).count() == 0


def test_secret_network():
    """Held-out hex keys are told from ordinary long names, and the threshold keeps recall."""
    rng = np.random.default_rng(1)
    rows, truth = [], []
    for k in range(600):
        good = k % 2
        token = "".join(rng.choice(list("0123456789abcdef"), 40)) if good else "-".join(
            "".join(rng.choice(list("etaoinshrdlu"), 6)) for _ in range(4)) + str(k)
        text = f"some {'key' if good else 'name'} {token} after"
        start, end = secret_scan.candidates(text)[0]
        rows.append(secret_scan._windows(text, start, end)[0])
        truth.append(float(good))
    rows, truth = np.stack(rows), np.array(truth)
    model = secret_scan.CharCnn.fresh()
    model.train(rows[:400], truth[:400], epochs=6)
    scores = model.scores(rows[400:])
    assert ((scores > 0.5) == truth[400:]).mean() > 0.97
    cut = secret_scan.calibrated(scores, truth[400:], 0.95, 0.001)
    assert (scores[truth[400:] == 1] >= cut).mean() >= 0.9 and (scores[truth[400:] == 0] >= cut).mean() <= 0.02


def test_secret_threshold_keeps_recall():
    """Others that score high, as secrets without a pattern do, never lift the threshold."""
    rng = np.random.default_rng(2)
    hits, others = rng.uniform(0.8, 1, 400), rng.uniform(0, 0.1, 4000)
    hidden = np.concatenate([others, rng.uniform(0.8, 1, 40), [1.5]])
    for more in (others, hidden):
        scores, truth = np.concatenate([hits, more]), np.repeat([1.0, 0.0], [len(hits), len(more)])
        assert 0.95 <= (hits >= secret_scan.calibrated(scores, truth, 0.95, 0.005)).mean() < 0.96
    cut = np.quantile(hits, 0.05)
    assert secret_scan.false_alarms(hits, hidden, cut) < 0.003 and secret_scan.false_alarms(hits, others, cut) == 0
    mixed = np.concatenate([others, rng.uniform(0.8, 0.9, 400)])
    assert secret_scan.false_alarms(hits, mixed, cut) > 0.05
    with pytest.warns(UserWarning, match="secret scan"):
        secret_scan.calibrated(np.concatenate([hits, mixed]), np.repeat([1.0, 0.0], [len(hits), len(mixed)]), 0.95, 0.001)


def test_secret_scan_learns_hidden(spark):
    """Keys that no pattern has are learned though the candidates held out hold some of them."""
    rng = np.random.default_rng(4)

    def key(n):
        return "".join(rng.choice(list("0123456789abcdef"), n))

    names = ["-".join("".join(rng.choice(list("etaoinshrdlu"), 6)) for _ in range(4)) + str(k) for k in range(600)]
    words = [*(key(40) for _ in range(300)), *names, *(key(30) for _ in range(16))]
    docs = spark.createDataFrame([(k, f"some word {w} after") for k, w in enumerate(words)], "doc_id long, text string")
    found = by_id(secret_scan.scan(docs))
    assert sum(s["kind"] == "learned" for k in range(900, 916) for s in found[k]["spans"]) >= 12
    assert sum(bool(found[k]["spans"]) for k in range(300, 900)) <= 6


def test_secret_scan_fits_on_all_candidates(spark):
    """More findings and documents than a bounded sample held; shards and layouts agree."""
    rng = np.random.default_rng(6)
    keys = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(1700)]
    names = ["-".join("".join(rng.choice(list("etaoinshrdlu"), 6)) for _ in range(4)) + str(k) for k in range(1700)]
    docs = spark.createDataFrame([(k, f"some word {w} after") for k, w in enumerate([*keys, *names])], "doc_id long, text string")
    more = docs.union(spark.range(4000, 36000).select("id", F.lit("nothing here")))
    rows, held = secret_scan.split_windows(more)
    assert rows.count() + held.count() == 3400 and 700 < held.count() < 1000
    one, two = (secret_scan.fit(more.repartition(n), shard=800) for n in (2, 5))
    assert one.threshold == two.threshold and (one.kernel == two.kernel).all()
    scored = secret_scan._scores(held, one).where("finding").agg(F.avg((F.col("score") >= one.threshold).cast("int")), F.count("*"))
    share, n = scored.first()
    assert 0.95 <= share < 0.95 + 2 / n
    assert secret_scan._scores(held, one).where(f"not finding and score >= {one.threshold}").count() <= 4


def test_licenses(some_docs, no_docs, plain):
    found = by_id(license_scan.scan(some_docs))
    for i, text in plain.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        starts, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            want = phrase.split()
            here = [k for k in range(len(words)) if words[k:k + len(want)] == want]
            starts += here
            labels |= {label} if here else set()
        row = found[i]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))), i
        assert labels <= set(row["labels"].split(",")) | {""} and 0 <= row["score"] <= 1
    assert found[15]["labels"] == "gpl-3" and license_scan.scan(no_docs).count() == 0


def test_byte_bpe(some_docs, no_docs, plain):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BYTE_BPE),
                                 special_tokens={})
    found = by_id(byte_bpe.digests(some_docs, BYTE_BPE, public_tokenizers.PATTERN))
    for i, text in plain.items():
        ids = encoding.encode_ordinary(text)
        raw = np.array(ids, "<u4").tobytes()
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (
            len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), i
    assert byte_bpe.digests(no_docs, BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_words_of_all_lengths(spark, monkeypatch):
    """Invented words, one above LONG bytes, with a store that is emptied on the way."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 40)
    rng = np.random.default_rng(5)
    alphabet = np.array(list("aaeionrstlcdz\u00e9\u4e2d"))
    texts = [" ".join("".join(rng.choice(alphabet, size)) for size in rng.integers(1, 60, 30)) for _ in range(40)]
    texts.append("".join(rng.choice(alphabet, byte_bpe.LONG)) + "b" + " ab" * 50 + " " + "a" * 300)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BYTE_BPE),
                                 special_tokens={})
    monkeypatch.setattr(byte_bpe, "prepare", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    coded = byte_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN)
    found = {r["doc_id"]: r for r in byte_bpe.decode(coded, BYTE_BPE).collect()}
    for i, text in enumerate(texts):
        assert np.frombuffer(found[i]["ids"], "<u4").tolist() == encoding.encode_ordinary(text), i
        assert bytes(found[i]["decoded"]) == text.encode(), i


def test_token_counts(some_docs, no_docs, plain):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    found = by_id(token_counts.token_counts(some_docs, WORD_BPE))
    for i, text in plain.items():
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert tuple(found[i])[1:] == (len(text.encode()), n, n > 2048), i
    assert token_counts.token_counts(no_docs, WORD_BPE).count() == 0


def test_packing(some_docs, no_docs, plain):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack_documents(some_docs, WORD_BPE, group=40, merged=4).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], {})[r["piece"]] = r
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in plain.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k in range(-(-len(ids) // 2048)):
            part, row = ids[2048 * k:2048 * (k + 1)], by_doc[i][k]
            assert (row["start"], row["length"], row["ids_crc32"]) == (2048 * k, len(part), zlib.crc32(part.tobytes())), i
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert packing.pack_documents(no_docs, WORD_BPE).count() == 0


def test_bounds():
    """The bound never passes the best packing, and is met where items fit exactly."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, count = packing.best_fit(lengths, 100)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= 100 and len(fill) == count and packing.lower_bound(lengths, 100) <= count
    assert packing.lower_bound(np.array([60] * 5), 100) == 5 and packing.lower_bound(np.array([34] * 6), 100) == 3


def test_fingerprints(odd_docs, no_docs, odd_texts):
    from trackloom.llm.near_dedup import WordHashes

    found = fingerprints.fingerprints(odd_docs).collect()
    assert len(found) == len(odd_texts) + 2 and fingerprints.fingerprints(no_docs).count() == 0
    order = sorted([*odd_texts, 4], reverse=True) + [None]
    text_of = {**odd_texts, None: "no id here"}
    got, words = by_id(odd_docs.sparkSession.createDataFrame(found)), WordHashes()
    for at, i in enumerate(order):
        text = text_of[i] or ""
        following = text_of[order[(at + 1) % len(order)]] or ""
        if i == 4:
            continue
        size = len(text) // 3
        new = text[:len(text) - size] + following[:size]
        a, b = fingerprints.of_text(text, words), fingerprints.of_text(new, words)
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest()), i
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (a.hex(), b.hex()), i
        assert got[i]["near_edited"] == a.likeness(b) and 0 <= got[i]["near_next"] <= 1
    assert got[4]["fingerprint"] == got[5]["fingerprint"]
    one, two = fingerprints.of_text("a b c d\ne f g", words), fingerprints.of_text("e f g\na b c d", words)
    assert one == two and one - fingerprints.of_text("e f g", words) == fingerprints.of_text("a b c d", words)
    assert fingerprints.Fingerprint.from_hex(one.hex()) == one


def test_queries_have_one_row_per_document(spark):
    count = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_quality_rules", "op2_secret_scan", "op4_pii"):
        assert queries.QUERIES[name][0](spark, SF).count() == count
