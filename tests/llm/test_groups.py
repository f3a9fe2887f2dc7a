"""Near duplicates, URL filters and the pipeline against plain versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import differences, oracle
from trackloom.llm import near_dedup, packing, pii, quality_rules, queries, url_filters
from trackloom.session import cut_lineage, shared_folder

SF = "/root/testdata/sf0.001"


def plain_groups(texts, threshold=85):
    """Component of each id, by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
    head = {i: i for i in texts}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def found_groups(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.duplicate_groups(docs).collect()}


def test_odd_groups(odd_docs, odd_texts, no_docs):
    found = found_groups(odd_docs)
    assert {i: found[i] for i in odd_texts} == plain_groups(odd_texts)
    kept = near_dedup.keep_one(odd_docs).collect()
    ids = [r["doc_id"] for r in kept]
    assert len(ids) == len(set(ids)) and 4 in ids and 5 not in ids and None in ids
    assert near_dedup.keep_one(odd_docs).columns == odd_docs.columns and near_dedup.keep_one(no_docs).count() == 0


def test_pairs_from_080_on(spark):
    """Without a threshold of its own, a job links pairs from 0.80 on; only the query stays at 0.85."""
    texts = {}
    for pair in range(40):
        words = [f"p{pair}w{k}" for k in range(150)]
        texts[2 * pair] = " ".join(words)
        cut = 120 + pair % 10  # 116 of 146 shingles are below 0.80, 117 and more above
        texts[2 * pair + 1] = " ".join(words[:cut])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    plain = plain_groups(texts, 80)
    assert 0 < sum(i == head for i, (_, head) in plain.items()) < sum(i == h for i, (_, h) in plain_groups(texts).items())
    assert found_groups(docs) == plain
    stay = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert stay == {i for i, (_, head) in plain.items() if i == head}


def test_op7_stays_at_085(spark, tmp_path):
    words = [f"w{k}" for k in range(150)]
    texts = {1: " ".join(words), 2: " ".join(words[:124])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_minhash_near_dedup(spark, str(tmp_path)).collect()}
    assert found == plain_groups(texts, 85) != plain_groups(texts, 80)


def test_an_id_with_several_texts_keeps_all_its_links(spark):
    one, two = [f"w{k}" for k in range(60)], [f"v{k}" for k in range(60)]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one, "z"])), (3, " ".join([*two, "z"])), (4, "alone in the world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.duplicate_groups(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_further_centres_settle_a_bucket(spark):
    """Two members link past the first centre: the next centres find it, all pairs are
    tried once, and nothing is left to the exact filter."""
    texts = {k: " ".join(f"t{k}w{j}" for j in range(60)) for k in (1, 2, 3)}
    texts[4] = texts[3] + " more"
    docs = spark.createDataFrame(list(texts.items()), "node long, text string")
    sets = docs.mapInArrow(near_dedup._setter(5), "node long, part long, shingles binary")
    members = spark.createDataFrame([(7, k, 56, 1) for k in texts] + [(8, 1, 56, 1), (8, 2, 56, 1)],
                                    "bucket long, node long, n long, centre long")
    pairs = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tried = near_dedup.confirmed(pairs, sets, 80)
    left, tried, joined = near_dedup._more_stars(members, tried, near_dedup.components(tried.where("linked").select("a", "b")),
                                                 sets, 80)
    pairs = sorted((r["a"], r["b"]) for r in tried.collect())
    assert pairs == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert [(r["node"], r["component"]) for r in joined.collect()] == [(4, 3)]  # a root has no row
    assert near_dedup._open(left, joined).count() == 0


def test_near_copies_below_the_threshold_do_not_all_meet(spark, monkeypatch):
    """Copies of one text, each with edits of its own: most pairs are just below the
    threshold, and hardly more are compared than link; no link is lost."""
    rng = random.Random(4)
    texts = {}
    for node in range(70):
        words = [f"w{k}" for k in range(900)]
        for slot in rng.sample(range(180), 11):
            words[5 * slot + 2] = f"e{node}x{slot}"
        texts[node] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "node long, text string")
    sets = cut_lineage(docs.mapInArrow(near_dedup._setter(5), "node long, part long, shingles binary"))
    members = spark.createDataFrame([(1, k, 896, 0) for k in texts], "bucket long, node long, n long, centre long")
    stars = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    tried, compared, confirmed = near_dedup.confirmed(stars, sets, 80), [], near_dedup.confirmed

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    monkeypatch.setattr(near_dedup, "STARS", 1)  # the filters alone
    joined = {r["node"]: r["component"] for r in near_dedup._finish(members, tried, sets, 80).collect()}
    plain = {i: head for i, (_, head) in plain_groups(texts, 80).items()}
    assert {i: joined.get(i, i) for i in texts} == plain and 2 < len(set(plain.values())) < 60
    assert sum(compared) < 600  # of 2,415 pairs


def test_tables_do_not_pile_up(spark):
    """What a job wrote on its way is gone with it; only its result stays."""
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = near_dedup.duplicate_groups(docs)
    assert len(set(os.listdir(folder)) - before) == 1 and groups.count() == docs.count()


def test_chains_and_shared_passages(spark):
    """Groups whose members link only through others, exact copies, and a passage in many documents."""
    rng = random.Random(9)
    texts, passage = {}, [f"p{k}" for k in range(60)]
    for group in range(6):
        words = [f"g{group}w{k}" for k in range(150)]
        for step in range(14):
            texts[len(texts)] = " ".join(words)
            words[rng.randrange(150)] = f"e{group}x{step}"
    for k in range(60):
        texts[len(texts)] = " ".join(passage + [f"d{k}w{j}" for j in range(rng.randint(20, 60))])
    for _ in range(20):
        texts[len(texts)] = texts[3]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert found_groups(docs) == plain_groups(texts)


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_query_matches_sql(spark, name):
    query, sql = queries.QUERIES[name]
    assert differences(query(spark, SF).toPandas(), oracle(SF, sql)) is None


def test_urls(spark):
    urls = {1: None, 2: "no scheme/x", 3: "HTTP://EXAMPLE.org/es/1?x", 4: "http://a.example.org/en/12", 5: "x://y.com/fr/", 6: "x://com/de/?",
            7: "x://notexample.org/es/", 8: "x://h.net", 9: "x://h.net?a://b/c", 10: "x://spam.net/a", 11: "x://spam.net/b#q", 12: "://#"}
    pages = spark.createDataFrame([(k, u, "html", 5) for k, u in urls.items()] + [(k, f"x://spam.net/{k}", "", 5) for k in range(100, 160)]
                                  + [(k, f"x://good{k % 3}.net/{k}", "", 5) for k in range(200, 260)],
                                  "page_id long, url string, html string, host int")
    labels = spark.createDataFrame([(k, 0, 0) for k in range(100, 160)] + [(k, 1, 0) for k in range(200, 260)],
                                   "doc_id long, quality int, toxic int")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judged(pages, labels).collect()}
    assert found[1] == ("", "", None, "allow") and found[2] == ("", "", None, "allow")
    assert found[3] == ("example.org", "/es/1", "example.org/es/", "block")
    assert found[4] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert found[5][2:] == ("com/fr/", "allow") and found[6][2:] == ("com/de/", "block") and found[7][2:] == ("org/", "allow")
    assert found[8][:2] == ("h.net", "") and found[9][:2] == ("h.net", "") and found[12][:2] == ("", "")
    assert found[10][3] == "block" and found[11] == ("spam.net", "/b", None, "block") and found[200][3] == "allow"
    assert url_filters.judged(pages.limit(0), labels).count() == 0
    assert {r["verdict"] for r in url_filters.judged(pages.where("page_id > 99"), labels.limit(0)).collect()} == {"allow"}


def test_pipeline(spark):
    """Each stage does what its operator says to all that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in quality_rules.judged(docs, labels).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    stay = {i for i, (_, head) in plain_groups(texts, 80).items() if i == head}
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs.where(docs.doc_id.isin(sorted(stay)))).collect()}
    final = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in final.select("doc_id").distinct().collect()} == stay
    cut = packing.pieces(spark.createDataFrame(list(masked.items()), "doc_id long, text string"), queries.public_tokenizers.path("word_bpe_49k.json"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, final.select(*names).collect())) == sorted(map(tuple, cut.select(*names).collect()))
    held = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, SF)
        assert held.columns == docs.columns


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path, odd_docs, odd_texts):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folders = {"empty": odd_docs.limit(0), "odd": odd_docs.withColumn("_row", F.lit("clash"))}
    for name, docs in folders.items():
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").select("doc_id").distinct().collect()}
    judged = quality_rules.judged(odd_docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = {r["doc_id"] for r in judged.where("kept").collect()}
    assert found == {i for i, (_, head) in plain_groups({k: v for k, v in odd_texts.items() if k in good}, 80).items() if i == head}
