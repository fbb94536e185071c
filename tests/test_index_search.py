import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators import index as ix
from folioscope.operators import prefix as px
from folioscope.operators import postings as po
from folioscope.operators import search as se
from folioscope.operators import vectors as ve
from folioscope.session import stage

TEXTS = [("a", "Aa b"), ("b", "aa aa"), ("c", "界 😀x")]


def grams(text):
    return [g for word in text.lower().split() for g in ix.ngrams_of(word)]


def by_hand(texts):
    counts = {k: Counter(grams(t)) for k, t in texts}
    df = Counter(t for c in counts.values() for t in c)
    rows = {}
    for key, c in counts.items():
        w = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows[key] = {t: x / norm for t, x in w.items()}
    return rows


def chunk_rows(spark, texts=TEXTS):
    return spark.createDataFrame(texts, "chunk_id string, text string")


def as_dict(vectors):
    return {r[0]: dict(zip(r.terms, r.weights)) for r in vectors.collect()}


def test_column_ngrams_equal_the_kernel(spark):
    rows = chunk_rows(spark).select("text", ix.char_ngrams(F.col("text")).alias("g")).collect()
    for r in rows:
        assert Counter(r.g) == Counter(grams(r.text)), r.text
    assert Counter(grams("a")) == Counter([" a", "a ", " a "])


def test_weights_by_hand_on_both_routes(spark):
    cut = chunk_rows(spark)
    vocab = ix.vocabulary(cut, 3)
    want = by_hand(TEXTS)
    for bound in (10_000, 1):  # within and beyond the broadcast bound
        got = as_dict(ix.tfidf_vectors(cut, vocab, broadcast_terms=bound))
        assert got.keys() == want.keys()
        for key in want:
            assert got[key] == pytest.approx(want[key]), key
    few = ix._weigh_by_join(cut, vocab, "chunk_id", "text", True, hot_terms=2)
    assert as_dict(few)["b"] == pytest.approx(want["b"])


def test_vocabulary_cap_and_merge(spark):
    cut = chunk_rows(spark)
    top = ix.vocabulary(cut, 3, 2).collect()
    every = sorted(Counter(g for _, t in TEXTS for g in grams(t)).items(), key=lambda p: (-p[1], p[0]))
    assert sorted((r.term, r.cf) for r in top) == sorted(every[:2])
    parts = [ix.vocabulary(cut.filter(c), 0) for c in (F.col("chunk_id") == "a", F.col("chunk_id") != "a")]
    merged = ix.merge_vocabulary(*parts, 3)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, ix.vocabulary(cut, 3).collect()))


def test_merge_keeps_or_replaces(spark):
    old = spark.createDataFrame([("a", "old")], "chunk_id string, text string")
    new = spark.createDataFrame([("a", "new"), ("b", "new")], "chunk_id string, text string")
    assert sorted(map(tuple, ix.merge_chunks(old, new).collect())) == [("a", "old"), ("b", "new")]
    assert sorted(map(tuple, ix.merge_chunks(old, new, replace=True).collect())) == [("a", "new"), ("b", "new")]


def test_dense_normalise_and_gate(spark):
    rows = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0])], "chunk_id string, v array<float>")
    got = {r[0]: r[1] for r in rows.select("chunk_id", ix.l2_normalise(F.col("v"))).collect()}
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["b"] == [0.0, 0.0]
    assert ix.dense_gate(rows, rows).first().has_embedding
    gate = ix.dense_gate(rows, rows.filter("chunk_id = 'a'")).first()
    assert not gate.has_embedding and gate.embedding_warning
    with pytest.raises(ValueError):
        ix.index_meta(rows.withColumn("source_file", F.lit("f")), None, 1, 0, backend="faiss")


def ranking(hits):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in hits.collect())


def test_search_routes_agree_with_ties_and_blocks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # a third of all chunks are copies of one text: equal scores must be cut by key
    copies = docs.select(F.format_string("copy%05d", "doc_id").alias("chunk_id"), F.lit("the onre of haing").alias("text"))
    cut = docs.select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text").unionByName(copies)
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    asked = asked.unionByName(spark.createDataFrame([(-1, "the onre"), (-2, "  "), (-3, "界界")], "query_id long, query string"))
    index = se.SparseIndex(cut)
    first = ranking(index.search(asked, 7))
    vectors = ix.tfidf_vectors(cut, index.vocab)
    assert ranking(se.sparse_top_k(vectors, se.query_vectors(asked, index.vocab), 7)) == first
    monkeypatch.setattr(se, "QUERY_BLOCK", 9)
    assert ranking(index.search(asked, 7)) == first
    # brute force over the long form
    postings = ix.postings(vectors)
    words = ix.postings(se.query_vectors(asked, index.vocab), "query_id").withColumnRenamed("weight", "q")
    scores = postings.join(words, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    assert ranking(se.rank_hits(scores, 7)) == first
    tied = [c for q, _, c, _ in first if q == -1]
    assert tied == [f"copy{i:05d}" for i in range(7)]
    assert not any(q in (-2, -3) for q, *_ in first)


def test_queries_that_share_terms_share_a_pass(spark):
    words = [f"w{n:03d}" for n in range(400)]
    asked = spark.range(600).select(
        F.col("id").alias("query_id"),
        F.array(*map(F.lit, words)).alias("terms"),
        F.array_repeat(F.lit(0.05), len(words)).alias("weights"),
    )
    (blocks,) = se._passes(asked, "terms")
    assert sum(block.count() for block in blocks) == 600
    assert all(block.count() <= se.QUERY_BLOCK for block in blocks)
    # queries without a common term: the tables of a pass stay bounded
    own = asked.limit(300).withColumn("terms", F.transform("terms", lambda t: F.concat(t, F.col("query_id"))))
    for blocks in se._passes(own, "terms"):
        assert sum(table.size for *_, table in map(se._query_table, blocks)) <= se.MAX_CELLS


def test_dense_against_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    matrix = {r.chunk_id: np.array(r.embedding, float) for r in rows.collect()}
    queries = rows.filter(F.col("chunk_id").isin("3", "8")).select(F.col("chunk_id").alias("query_id"), "embedding")
    for r in se.dense_top_k(rows, queries, 4).collect():
        a, b = matrix[r.query_id], matrix[r.chunk_id]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
        assert r["rank"] != 1 or r.chunk_id == r.query_id


def test_batch_best_keeps_exactly_k():
    rng = np.random.default_rng(0)
    scores = np.round(rng.random((200, 5)), 1)
    for k in (1, 3, 50, 500):
        for positive in (True, False):
            row, column = se._batch_best(scores, k, positive)
            for c in range(5):
                order = sorted(range(200), key=lambda i: (-scores[i, c], i))
                assert sorted(row[column == c]) == sorted(i for i in order[:k] if not positive or scores[i, c] > 0)


def test_variants_and_fusion(spark):
    rows = spark.createDataFrame(
        [(1, "q", "q ", []), (2, "q", "q more", ["k1", "k2"]), (3, "q", "", [])],
        "query_id long, original string, expanded string, keywords array<string>",
    )
    got = {}
    for r in se.query_variants(rows).collect():
        got.setdefault(r.query_id, {})[r.match_type] = r["query"]
    assert got[1].keys() == got[3].keys() == {"embedding_original", "tfidf_original"}
    assert got[2]["tfidf_keywords"] == "q q more k1 k2" and len(got[2]) == 5
    lists = spark.createDataFrame(
        [(1, "x", 0.5, "tfidf_original", 3), (1, "x", 0.4, "embedding_original", 1), (1, "y", 0.9, "odd", 9)],
        "query_id long, chunk_id string, score double, match_type string, list_no int",
    )
    best = se.fuse(lists, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.match_type) for r in best] == [("x", "embedding_original, tfidf_original"), ("y", "odd")]
    assert best[0].score == pytest.approx(0.85) and best[1].score == pytest.approx(0.675)


def test_prefix_scans_equal_plain_windows(spark):
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.col("id").alias("o"),
        F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).alias("v"),
    )
    plain = W.partitionBy("k").orderBy("o")
    counted = px.running_count(rows, ["k"], "o", F.col("v").isNotNull(), "n", block=17)
    want = rows.withColumn("n", F.sum(F.col("v").isNotNull().cast("long")).over(plain))
    assert counted.select("o", "n").exceptAll(want.select("o", "n")).isEmpty()
    before = px.running_last(rows, ["k"], "o", ["v"], block=17)
    want = rows.withColumn("b", F.last("v", ignorenulls=True).over(plain.rowsBetween(W.unboundedPreceding, -1)))
    got = before.select("o", F.col("v_before").alias("b"))
    assert got.exceptAll(want.select("o", "b")).isEmpty() and got.count() == 500


def _hits(hits):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in hits.collect())


def test_postings_index(spark, tmp_path):
    topics = ["alpha beta", "gamma delta", "wolf tiger", "stone river"]
    rows = [(f"c{t}{i:02d}", f"{topics[t]} {'word' * (i % 3)} n{i}") for t in range(4) for i in range(20)]
    rows += [("d1", None), ("d2", ""), ("d3", "alpha beta "), ("d4", "alpha beta")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    asked = spark.createDataFrame(
        [(1, "wolf tiger n3"), (2, "alpha"), (3, "zzz"), (4, ""), (5, "stone river word n7")], "query_id long, query string"
    )
    root = f"{tmp_path}/index"
    index = po.PostingsIndex(spark, root, buckets=8, window=8)
    assert index.search(asked, 3).count() == 0 and index.vocabulary().count() == 0
    index.append(chunks)
    assert _hits(index.search(asked, 3)) == _hits(se.SparseIndex(chunks, max_features=None).search(asked, 3))
    # windows out of reach are not scored, and only the asked terms' folders are read
    read = index.reading(asked, 3).first()
    assert 0 < read.pairs_scored < read.pairs and read.postings_read < read.postings
    one = asked.filter("query_id = 2")
    few = ix.term_counts(one, "query").select("term")
    plan = index._of_terms(index.postings(), few.limit(1))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]
    assert index.reading(one.select("query_id", F.lit("zq").alias("query")), 3).count() <= 1


def test_postings_segments(spark, tmp_path):
    base = [(f"c{i:03d}", f"word{i % 7} other{i % 5} text {'x' * (i % 4)}") for i in range(60)]
    asked = spark.createDataFrame([(1, "word3 other2"), (2, "xxx text"), (3, "fresh words")], "query_id long, query string")

    def frame(rows):
        return spark.createDataFrame(rows, "chunk_id string, text string")

    index = po.PostingsIndex(spark, f"{tmp_path}/index", buckets=4, window=8)
    index.append(frame(base[:30]))
    index.append(frame(base[20:60] + [("c010", "must not win")]))  # ids that are there keep their text
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "index/postings").rglob("*.parquet")}
    changed = {f"c{i:03d}": f"fresh words {i}" for i in range(0, 60, 6)}
    index.append(frame(list(changed.items())), replace=True)
    assert all(p.stat().st_mtime_ns == t for p, t in old.items())  # earlier segments are left alone
    now = frame([(c, changed.get(c, text)) for c, text in base])
    whole = se.SparseIndex(now, max_features=None)
    vocab = sorted((r.term, r.df, r.cf, round(r.idf, 9)) for r in whole.vocab.collect())
    want = _hits(whole.search(asked, 6))
    for reopened in (False, True):
        if reopened:
            assert index.compact() == 4 and index.segments == [4]
            index = po.PostingsIndex(spark, f"{tmp_path}/index", window=8)
        assert _hits(index.search(asked, 6)) == want
        assert sorted((r.term, r.df, r.cf, round(r.idf, 9)) for r in index.vocabulary().collect()) == vocab
    assert index.chunks().count() == 60 and index.buckets == 4


@pytest.mark.parametrize("terms", [None, 0])
def test_postings_weighed_where_cut(spark, tmp_path, monkeypatch, terms):
    names = []

    def noted(df, name, *a):
        names.append(name)
        return staged(df, name, *a)

    staged = po.stage
    monkeypatch.setattr(po, "stage", noted)
    if terms is not None:
        monkeypatch.setattr(po, "MAX_BROADCAST_TERMS", terms)
    rows = [(f"c{i:02d}", f"word{i % 7} some{i % 5} text {'x' * (i % 4)}") for i in range(40)] + [("none", None), ("blank", " ")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "word3 some2"), (2, "xxx text")], "query_id long, query string")
    index = po.PostingsIndex(spark, f"{tmp_path}/index", buckets=4, window=8)
    for part in (chunks.limit(0), chunks.filter("chunk_id < 'c2'"), chunks):
        index.append(part)
    # with a vocabulary that can be sent, postings are not written and shuffled again for their weights
    assert ("windows" in names) == (terms == 0)
    whole = se.SparseIndex(chunks, max_features=None)
    assert _hits(index.search(asked, 5)) == _hits(whole.search(asked, 5)) and index.chunks().count() == 42
    index.compact()
    assert _hits(index.search(asked, 5)) == _hits(whole.search(asked, 5)) and index.chunks().count() == 42
    # squares come as one row per task and window
    found = index.postings().join(index.vocabulary().select("term", "idf"), "term").coalesce(1)
    norms = {(r.window, i): n for r in index.norms().collect() for i, n in zip(r.slots, r.norms)}
    squares = po._squares(found).collect()
    assert len(squares) == found.select("window").distinct().count() < found.count()
    for r in squares:
        assert [v**0.5 for v in r.squares if v] == pytest.approx([norms[r.window, i] for i, v in enumerate(r.squares) if v])


def test_vector_index(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    odd = spark.createDataFrame([("short", [1.0]), ("none", None), ("zero", [0.0] * 64)], "chunk_id string, embedding array<float>")
    asked = rows.filter(F.col("chunk_id").cast("int") % 25 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    index = ve.VectorIndex(rows.unionByName(odd), str(tmp_path / "vectors"), 64, bucket_rows=20)
    assert {(r.chunk_id, r.length) for r in index.errors.collect()} == {("short", 1), ("none", -1)}
    exact = se.dense_top_k(index.vectors, asked, 10)
    reached = index.tune(asked, 10)
    assert reached >= 0.9 and index.probes < 1 << index.bits
    got = index.search(asked, 10)
    assert ve.recall(got, exact) == pytest.approx(reached) and got.groupBy("query_id").count().filter("count <> 10").isEmpty()
    assert _hits(index.search(asked, 10, probes=1 << index.bits)) == _hits(exact)
    assert "bucket" in got._jdf.queryExecution().toString() and index.search(asked.limit(0), 3).count() == 0
    assert ve.recall(got, exact.limit(0)) == 1.0


def _rows_of_counter(texts, lower=True):
    counter = ix._Counter()
    for part in ix.text_slices(texts):
        spaced = ix.spaced(texts[part], lower)
        assert counter.takes(spaced)
        counter.add(spaced)
    return {r["term"]: (r["df"], r["cf"]) for r in counter.flush().to_pylist()}


def test_packed_grams_equal_those_by_word():
    texts = ["Aa b", None, "", " \x00 a　\x00b 界😀 İ", "a", "aa aa\naa", "x" * 50] * 40
    assert len(list(ix.text_slices(texts * 3))) > 1
    by_word = {r["term"]: (r["df"], r["cf"]) for r in ix._counted_by_word(texts, True).to_pylist()}
    assert _rows_of_counter(texts) == by_word
    assert _rows_of_counter([None, ""]) == {}


def test_tallies_equal_summed_counts():
    grams, tfs, _ = ix.packed_grams(ix.spaced(["ab ab cd", "ab", "cd ef ef ef"], True), np.arange(ix.CODE_POINTS).astype(np.uint16))
    for got, wanted in zip(ix._tallied(grams, tfs), ix._summed(grams, np.ones(len(grams), np.int64), tfs), strict=True):
        assert got.dtype == wanted.dtype and got.tolist() == wanted.tolist()
    assert [len(column) for column in ix._tallied(grams[:0], tfs[:0])] == [0, 0, 0]


def test_staged_row_groups_are_shared_by_tasks(spark):
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"))
    staged = stage(rows.coalesce(1), "rows", group=1 << 19)
    (file,) = staged.inputFiles()
    assert pq.ParquetFile(file.removeprefix("file://")).num_row_groups > 2
    assert staged.distinct().count() == 40_000


def test_weigher_and_scorer_equal_sums_by_hand():
    texts = ["Aa b", None, "aa aa \x00", "界 😀x zz"]
    terms = sorted({g for t in texts for g in grams(t or "")} - {"zz"}) + ["longer term"]
    words = ix.Words(ix.pa.array(terms), np.arange(1.0, len(terms) + 1))
    at, weights, row = ix.Weigher(words, True).rows(texts)
    dense = np.zeros((len(texts), len(terms)))
    dense[row, at] = weights
    for n, text in enumerate(texts):
        own = Counter(g for g in grams(text or "") if g in terms)
        raw = np.array([own[t] * (i + 1.0) for i, t in enumerate(terms)])
        assert np.allclose(dense[n], raw / (np.sqrt(raw @ raw) or 1.0))
    table = np.random.default_rng(0).random((len(terms), 20))
    table[::2, 1:] = 0  # terms of one query in twenty, and of all
    assert np.allclose(se.Scorer(table).scores(len(texts), row, at, weights), dense @ table)


def test_ngrams_of_ids_that_repeat(spark, tmp_path):
    from folioscope.plans.core import char_ngrams

    rows = [(1, "ab"), (1, "ab cd"), (2, "xy"), (3, " "), (4, None), (None, "q"), (None, "q r")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {}
    for key in (1, 2, None):
        own = [g for k, t in rows if k == key for g in grams(t or "")]
        wanted[key] = (len(own), len(set(own)), max(own))
    found = char_ngrams(spark, str(tmp_path))
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == wanted
    # rows of ids that do not repeat are not exploded into n-grams and grouped
    assert found.schema.simpleString() == "struct<doc_id:bigint,n_grams:bigint,n_terms:bigint,last_term:string>"


def test_recall_is_tuned_on_a_bounded_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ve, "SAMPLE", 20)
    values = np.random.default_rng(1).standard_normal((400, 8))
    rows = spark.createDataFrame([(f"v{n}", v.tolist()) for n, v in enumerate(values)], "chunk_id string, embedding array<double>")
    asked = rows.select(F.col("chunk_id").alias("query_id"), "embedding")
    index = ve.VectorIndex(rows, f"{tmp_path}/v", 8, bucket_rows=20)
    sizes, full = [], se.dense_top_k
    monkeypatch.setattr(se, "dense_top_k", lambda v, q, k: sizes.append(q.count()) or full(v, q, k))
    assert index.tune(asked, 5) >= 0.9
    assert sizes == [20]
    assert ve.recall(index.search(asked, 5), full(rows, asked, 5)) >= 0.85


def test_stored_counts_give_the_scores_of_stored_weights(spark, tmp_path):
    from folioscope.sources import store

    rows = [("a", "alpha beta alpha"), ("b", "beta gamma"), ("c", None), ("d", ""), ("b", "beta gamma"), ("e", "delta " * 400), (None, "alpha")]
    chunks = spark.createDataFrame([*rows, *[(f"x{i}", f"word{i} {i * 7919} alpha") for i in range(600)]], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "alpha gamma"), (2, "delta word17"), (3, "zzz"), (4, None)], "query_id long, query string")
    plain = ix.vocabulary(chunks, chunks.count())
    vocab = ix.numbered(plain)
    packed = ix.tfidf_vectors(chunks, vocab)
    assert packed.columns == ["chunk_id", "counts"]
    store.save_index(str(tmp_path), chunks, vocab, packed, ix.index_meta(chunks, None, 700, 80, "tfidf"))
    index = store.load_index(spark, str(tmp_path))
    asked = se.query_vectors(queries, index["vocab"].select("term", "idf"))
    got = se.sparse_top_k(index["vectors"], asked, 5, index["vocab"])
    want = se.sparse_top_k(ix.tfidf_vectors(chunks, plain), se.query_vectors(queries, plain), 5)
    plainly = lambda hits: sorted(repr((r.query_id, r.chunk_id, r["rank"], round(r.score, 9))) for r in hits.collect())
    assert plainly(got) == plainly(want) and got.count() >= 10
    sizes = packed.agg(F.sum(F.length("counts"))).first()[0], ix.tfidf_vectors(chunks, plain).agg(F.sum(F.size("terms"))).first()[0]
    assert sizes[0] < 5 * sizes[1]  # a weight alone has eight bytes


def test_packed_counts_come_back():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, top, 50)), n) for top, n in ((60, 3), (5000, 300), (1 << 22, 70_000))]
    rows = [(at, rng.integers(1, n, len(at))) for at, n in rows] + [(np.empty(0, np.int64), np.empty(0, np.int64))]
    at, tfs, row = ix.unpack([ix.pack(*r) for r in rows])
    assert np.array_equal(at, np.concatenate([r[0] for r in rows])) and np.array_equal(tfs, np.concatenate([r[1] for r in rows]))
    assert np.array_equal(row, np.repeat(np.arange(4), [len(r[0]) for r in rows]))


def test_an_upsert_leaves_no_copies(spark, tmp_path):
    import os

    from folioscope.session import staging_root
    from folioscope.sources import store

    parsed = store.DocumentStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "1"), ("b", "1")], "textbook_id string, title string")
    parsed.save("documents", rows)
    folder = f"{staging_root(spark)}/staged"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    parsed.save("documents", parsed.load("documents"))
    assert sorted(map(tuple, parsed.load("documents").collect())) == [("a", "1"), ("b", "1")]
    assert set(os.listdir(folder)) == before


def test_an_append_keeps_no_copies_and_shuffles_no_postings(spark, tmp_path, monkeypatch):
    import os

    from folioscope.session import staging_root

    rows = [(f"c{i:04d}", " ".join(f"w{(i * k) % 97}" for k in range(1, 30))) for i in range(700)]
    chunks = spark.createDataFrame([*rows, ("null", None), ("empty", "")], "chunk_id string, text string")
    folder = f"{staging_root(spark)}/staged"
    written = []
    write = po.PostingsIndex._write

    def seen(self, rows):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        written.append("Repartition" in plan.split("MapInArrow")[0])
        write(self, rows)

    monkeypatch.setattr(po.PostingsIndex, "_write", seen)
    index = po.PostingsIndex(spark, f"{tmp_path}/index", buckets=4, window=16)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    index.append(chunks)
    index.append(chunks.limit(5).withColumn("text", F.lit("w1 changed")), replace=True)
    new = {name.split("-")[0] for name in set(os.listdir(folder)) - before}
    assert not new & {"given", "windows", "weighed"} and written == [False, False]
    assert index.postings().filter("term IS NULL").isEmpty()
    assert index.chunks().count() == 702 == index.chunks().select("chunk_id").distinct().count()
    # the index is that of one built anew
    anew = po.PostingsIndex(spark, f"{tmp_path}/anew", window=64)
    changed = chunks.join(index.chunks().filter("segment = 2").select("chunk_id", F.lit(True).alias("_c")), "chunk_id", "left")
    anew.append(changed.select("chunk_id", F.when(F.col("_c"), "w1 changed").otherwise(F.col("text")).alias("text")))
    queries = spark.createDataFrame([(i, f"w{i} w{i * 3} changed") for i in range(40)], "query_id int, query string")
    found = [sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in i.search(queries, 7).collect()) for i in (index, anew)]
    assert found[0] == found[1] and len(found[0]) > 100
