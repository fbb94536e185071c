"""Operators with models or search, against brute force, planted cases and held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from folioscope.llm import contamination, licenses, near, suffix_tree, toxicity
from folioscope.llm.common import remainder
from tests.llm.conftest import LONG, ODD

SF = "/root/testdata/sf0.01"


def rows_of(spark, name, sf_dir=SF):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


# licenses


def test_license_query_finds_whole_notices(spark):
    found = {(r.doc_id, r.license) for r in entry.queries()["op3_license_scan"](spark, SF).collect()}
    want = set()
    for r in rows_of(spark, "documents"):
        text = b" " + b" ".join(licenses.plain_words((r.text or "").encode())) + b" "
        for name, notice in licenses.TEMPLATES.items():
            if b" " + b" ".join(licenses.plain_words(notice.encode())) + b" " in text:
                want.add((r.doc_id, name))
    assert want and want == found


def test_license_edited_and_odd(spark, odd, nothing):
    words = licenses.TEMPLATES["MIT-text"].split()
    words[40] = "changed"
    rows = [(1, "start " * 50 + " ".join(words) + " end" * 50), (2, LONG), (3, " ".join(words[: len(words) // 2]))]
    found = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in found] == [(1, "MIT-text")]
    assert 0.8 <= found[0].containment < 1 and found[0].first_word == 50
    assert licenses.find_licenses(odd).count() == 0 and licenses.find_licenses(nothing).count() == 0
    assert licenses.find_licenses(odd, templates={"short": "two words"}).count() == 0


# contamination


def least_edits(item, text):
    before = list(range(len(item) + 1))
    best = before[-1]
    for c in text:
        now = [0]
        for i, p in enumerate(item):
            now.append(min(before[i] + (p != c), before[i + 1] + 1, now[i] + 1))
        before, best = now, min(best, now[-1])
    return best


def test_passages_equal_alignment():
    random.seed(2)
    for _ in range(150):
        item = "".join(random.choice("abcde ") for _ in range(random.randint(20, 120))).strip() or "abcdefghi"
        edited = list(item)
        for _ in range(random.randint(0, 14)):
            at = random.randrange(len(edited) + 1)
            edited[at : at + random.randint(0, 1)] = random.choice(["", "x", "y"])
        pad = ["".join(random.choice("fgh ") for _ in range(random.randint(0, 60))) for _ in range(2)]
        text = pad[0] + "".join(edited) + pad[1]
        index = contamination.Items([(1, item)], contamination.Q, contamination.PERCENT)
        if not index.keys:
            continue
        least = least_edits(*("".join(map(chr, codes)) for codes in (index.codes[0], contamination.normal(text)[0])))
        found = list(index.matches(["zz", text, ""]))
        assert bool(found) == (least <= index.edits[0])
        assert not found or (found[0][0], found[0][4]) == (1, least)


def test_contamination_query(spark):
    def plain(text):
        return " ".join((text or "").lower().split())

    items = {r.item_id: plain(r.text) for r in rows_of(spark, "benchmark")}
    want = {(r.doc_id, k) for r in rows_of(spark, "documents") for k, item in items.items() if item in plain(r.text)}
    found = entry.queries()["op7_decontamination"](spark, SF).collect()
    assert want <= {(r.doc_id, r.item_id) for r in found}
    text = {r.doc_id: r.text for r in rows_of(spark, "documents")}
    assert all(plain(text[r.doc_id][r.start : r.end]) == items[r.item_id] for r in found if r.edits == 0)
    dropped = contamination.drop_contaminated(
        spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    )
    assert {r.doc_id for r in dropped.collect()} == set(text) - {r.doc_id for r in found}


def test_contamination_odd(spark, odd, nothing):
    items = [(1, "Alpha BETA gamma delta epsilon zeta eta"), (2, None), (3, ""), (4, "x"), (5, "Alpha BETA gamma delta epsilon zeta eta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.find_passages(odd, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in found) == [(1, 1, 0), (1, 5, 0), (6, 1, 0), (6, 5, 0)]
    kept = contamination.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    assert contamination.find_passages(nothing, bench).count() == 0
    assert contamination.find_passages(odd, bench.limit(0)).count() == 0
    assert contamination.drop_contaminated(odd, bench.limit(0)).count() == len(ODD)


def test_contamination_blocks(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(i, f"alpha beta gamma delta epsilon zeta e{'t' * i}") for i in range(6)], "item_id long, text string")
    whole = sorted(contamination.find_passages(odd, bench).collect())
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 60)
    assert sorted(contamination.find_passages(odd, bench).collect()) == whole


# toxicity


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in entry.queries()["op4_toxicity"](spark, sf_dir).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id].score, r.toxic) for r in rows_of(spark, "labels", sf_dir) if got[r.doc_id].held_out]
    positive, negative = (np.array([s for s, t in held if t == label]) for label in (1, 0))
    area = (positive[:, None] > negative).mean() + (positive[:, None] == negative).mean() / 2
    assert area > 0.95 and (positive >= 0.3).mean() > 0.85 and (negative >= 0.3).mean() < 0.03


def test_toxicity_reads_no_held_out_labels(spark, tables):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    held = remainder("doc_id", 4) == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    one = entry.queries()["op4_toxicity"](spark, tables(documents=docs, labels=labels)).collect()
    two = entry.queries()["op4_toxicity"](spark, tables(documents=docs, labels=turned)).collect()
    assert {r.doc_id: r.score for r in one} == pytest.approx({r.doc_id: r.score for r in two})


def test_toxicity_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (77, 1), (5, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        kept = toxicity.drop_toxic(odd, some, F.lit(True))
        assert kept.columns == odd.columns
        scored = toxicity.score(odd, toxicity.fit(odd, some, F.lit(True))).collect()
        assert len(scored) == len(ODD) and all(0 <= r.toxicity <= 1 for r in scored)
    model = toxicity.fit(nothing, labels, F.lit(True))
    assert toxicity.score(nothing, model).count() == 0
    bad = spark.createDataFrame([(1, "you are an idiot, pathetic scum"), (2, "a kind word")], "doc_id long, text string")
    high, low = (r.toxicity for r in toxicity.score(bad, model).orderBy("doc_id").collect())
    assert high > 0.3 > low


# language model


def test_lm_base_and_gain(spark):
    got = {r.doc_id: r for r in entry.queries()["op5_lm_score"](spark, SF).collect()}
    source = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in rows_of(spark, "documents")}
    counts = Counter()
    for key, words in source.items():
        if zlib.crc32(str(key).encode()) % 7 != 2:
            counts.update(words)
    total, distinct = sum(counts.values()), len(counts)
    for key, words in source.items():
        r = got[key]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert r.base_score == pytest.approx(base) and r.train_tokens == total and r.n_tokens == len(words)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert r.held_out == (zlib.crc32(str(key).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_states_are_distributions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = docs.select("text")
    counts = suffix_tree.count_words(texts).collect()
    total = sum(r.n for r in counts)
    frequent = [(bytes(r.word), r.n) for r in counts if r.n >= 20]
    alphabet = suffix_tree.Alphabet(frequent)
    tree = suffix_tree.grow(texts, alphabet, total, len(counts), 3, 2e-4, 2e-5)
    assert len(tree.contexts) == 3 and all(len(k) for k in tree.contexts)
    words = np.arange(len(frequent))
    rare = 1 - np.exp(tree.root).sum()  # all words outside the alphabet, unknown ones included
    random.seed(4)
    for codes in tree.codes:
        for code in random.sample(list(codes), min(20, len(codes))):
            same = np.full(len(words), code)
            mass = np.exp(tree._walk(same, words)).sum() + rare * np.exp(tree._weights(same[:1]))[0]
            assert mass == pytest.approx(1, abs=1e-6)


def test_lm_odd(spark, odd, nothing):
    got = suffix_tree.score(odd, F.col("doc_id") != 9).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert by_id[2].n_tokens == 1 and by_id[9].held_out and by_id[5].n_tokens == 60_001
    twins = [r for r in got if r.doc_id == 7]
    assert len(twins) == 2 and twins[0].base_score == pytest.approx(twins[1].base_score) and twins[0].n_known == 2
    assert suffix_tree.score(nothing, F.lit(True)).count() == 0
    untrained = suffix_tree.score(odd, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)


# pipeline


def test_pipeline_stages(spark, tables):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        path = tables(kept=done)
        before, docs = docs, spark.read.parquet(f"{path}/kept.parquet")
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= {r.doc_id for r in before.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
    assert kept["byte-level BPE"] == kept["decontamination"]
    assert len(kept["exact dedup"]) < len(kept["toxicity"]) and len(kept["near dedup"]) < len(kept["exact dedup"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept["byte-level BPE"]
    original = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.text == original[r.doc_id] and len(r.ids) == r.n_tokens for r in docs.collect())


def test_pipeline_odd(spark, odd, tables):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "not in there at all")], "item_id long, text string")
    for docs in (odd, odd.limit(0)):
        assert corpus_pipeline.run(spark, tables(documents=docs, labels=labels, benchmark=bench)).count() in (0, 8, 7)


def test_lm_tables_equal_tree_in_memory(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = docs.select("text")
    counts = suffix_tree.count_words(texts).collect()
    total = sum(r.n for r in counts)
    alphabet = suffix_tree.Alphabet([(bytes(r.word), r.n) for r in counts if r.n >= 2])
    tree = suffix_tree.grow(texts, alphabet, total, len(counts), 3, 8 / total, 2 / total)
    want = {r.doc_id: tree.score(*alphabet.flat([(r.text or "").encode()]))[0] for r in docs.collect()}
    for sent, hot in ((suffix_tree.SENT, suffix_tree.HOT), (500, 100)):
        monkeypatch.setattr(suffix_tree, "SENT", sent)
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        got = suffix_tree.score(docs, F.lit(True), context_n=8, edge_n=2).collect()
        assert {r.doc_id: r.score - r.base_score for r in got} == pytest.approx(want, abs=1e-4)


def test_lm_strings_stay_when_the_corpus_grows(spark):
    docs = [(i, "the old mill by the river turns") for i in range(20)]
    more = [(100 + i, " ".join(f"w{i}x{j % 500}" for j in range(3000))) for i in range(400)]
    for rows in (docs, docs + more):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r for r in suffix_tree.score(df, F.lit(True)).collect()}
        # all words but the first three are told by what stands before them
        assert got[0].score - got[0].base_score > 4


def test_toxicity_voters_from_all_labelled_rows(spark):
    plain = [(i, f"n{i} about gardens") for i in range(4000)]
    rude = [(5000 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 3)}q n{i} about gardens") for i in range(78 * 10)]
    docs = spark.createDataFrame(plain + rude, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 5000).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, F.lit(True), sample=50)
    words = {text.split()[0].encode() for _, text in rude}
    assert len(words) == 78 and words <= model.voters.place.keys()


def test_toxicity_links_from_triples():
    rng = np.random.default_rng(3)
    rows, prior, size = 200_000, 0.1, 6
    hidden = rng.random(rows) < prior
    on = np.array([0.3, 0.4, 0.5, 0.6, 0.7, 0.8])
    votes = rng.random((rows, size)) < np.where(hidden[:, None], on, 0.02)
    want = [np.corrcoef(votes[:, i], hidden)[0, 1] for i in range(size)]
    together = votes.T.astype(float) @ votes
    model = toxicity.LabelModel(rows, together, prior, np.zeros(size + 1), np.zeros(size + 1), 0, 0)
    assert model.link == pytest.approx(want, abs=0.03)


def test_toxicity_insult_without_labelled_row(spark):
    docs = [(i, f"n{i} about gardens") for i in range(300)] + [(400 + i, f"n{i} you idiot") for i in range(40)]
    unlabelled = [(500 + i, f"n{i} gilipollas") for i in range(20)]
    frame = spark.createDataFrame(docs + unlabelled, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 400)) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels, F.lit(True))
    bad = spark.createDataFrame([(1, "hola gilipollas"), (2, "hola amigo")], "doc_id long, text string")
    high, low = (r.toxicity for r in toxicity.score(bad, model).orderBy("doc_id").collect())
    assert high > 2 * low


def test_toxicity_votes_by_word_are_those_by_sign(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 7)  # what is remembered is dropped and made again
    voters = toxicity.Voters([b"idiot", b"idio*", b"idiot*", b"morons", b"moro*", b"\xc3\xa9t\xc3*", b"zzzz*"])
    pool = "idio idiot idiots idiotic moron morons moro mor été étés étage zzzz clean words YOU!! ok".split()
    for seed in range(300):
        text = " ".join(np.random.default_rng(seed).choice(pool, seed % 9)).encode()
        signs = toxicity.signs_of(text)
        words = {s for s in signs if not s.endswith(b"*")}
        expected = {voters.place[s] for s in signs & voters.place.keys()}
        for begin in {s for s in signs & voters.place.keys() if s.endswith(b"*")}:
            if sum(w.startswith(begin[:-1]) for w in words) > 1:
                expected.add(voters.twice[voters.place[begin]])
        expected |= {voters.patterns + i for i, p in enumerate(toxicity.PATTERNS) if p.search(text)}
        assert voters.votes(text, toxicity.words_of(text)) == sorted(expected)


def test_near_sets_shuffle_no_texts(spark):
    docs = spark.createDataFrame([(i, f"alpha beta w{i} gamma delta") for i in range(50)], "doc_id long, text string")
    wanted = spark.createDataFrame([(3,), (3,), (41,), (None,), (99,)], "doc_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = near._sets(docs, wanted, "doc_id", "text", 2)
        plan = sets._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r.doc_id for r in sets.collect()) == [3, 41]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # sets are made from the scan; only they meet the wanted ids
    assert "MapInArrow" in plan and "Join" not in plan[plan.index("MapInArrow") :].split("Aggregate")[0]
