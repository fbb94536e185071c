import json

from pyspark.sql import functions as F

from folioscope.operators import chunk as ck
from folioscope.operators import feedback as fb
from folioscope.sources import catalog, files, store
from folioscope.streaming import feedback as sf_stream
from folioscope.streaming import ingest as st


def test_files_are_listed_decoded_and_dispatched(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "01_a.md").write_text("# 标题\n内容", encoding="utf-8")
    (root / "sub" / "中文书.txt").write_bytes("第一章 细胞\n正文内容".encode("gbk"))
    (root / "x.xyz").write_text("?")
    (root / "y.pdf").write_text("?")
    found = files.list_files(spark, str(root))
    documents, chapters = files.parse_files(found)
    status = {r.filename: (r.parse_status, r.error) for r in documents.collect()}
    assert status["x.xyz"] == ("failed", "Unsupported format: .xyz") and status["y.pdf"][0] == "pending"
    assert status["01_a.md"][0] == "completed"
    assert {(r.title, r.content) for r in chapters.collect()} == {("标题", "内容"), ("第一章 细胞", "正文内容")}
    (root / "a long beginning of a name 1.txt").write_text("one")
    (root / "a long beginning of a name 2.txt").write_text("two")
    same = files.list_files(spark, str(root), "a long*")
    counted = catalog.summary(*files.parse_files(same)).collect()
    assert [r.chapter_count for r in counted] == [1, 1] and len({r.textbook_id for r in counted}) == 1
    wanted = spark.createDataFrame([("01_a.md",), ("gone.md",)], "filename string")
    keep, missing = files.requested_files(found, wanted)
    assert keep.count() == 1 and [tuple(r) for r in missing.collect()] == [("gone.md", "File not found")]


def test_texts_are_written_as_sparks_writer_does_and_scanned_by_few_tasks(spark, tmp_path):
    from folioscope.session import many_files

    rows = [("a", "one"), ("a", "one"), ("b/=%é", "two\nlines"), ("", "no name"), (None, None), ("c", None), ("c", "")]
    rows = spark.createDataFrame(rows + [("many", f"text {i}") for i in range(500)], "source string, text string")

    def held(name):
        found = files.list_files(spark, str(tmp_path / name), "*.txt")
        folder = F.element_at(F.split("path", "/"), -2).alias("folder")
        return sorted(tuple(r) for r in found.select(folder, F.col("content").cast("string")).collect())

    files.write_texts(rows, str(tmp_path / "own"), "source")
    rows.write.partitionBy("source").option("maxRecordsPerFile", 1).text(str(tmp_path / "spark"))
    assert held("own") == held("spark") and len(held("own")) == 507
    files.write_texts(rows.limit(0), str(tmp_path / "none"), "source")
    assert held("none") == []
    with many_files(spark):
        assert files.list_files(spark, str(tmp_path / "own")).rdd.getNumPartitions() <= 8


def test_page_scan(spark):
    rows = spark.createDataFrame(
        [("f", "p", 1, " ", None), ("f", "p", 2, "x", ""), ("f", "p", 9, "y", None), ("g", "p", 1, None, "bad")],
        "source_file string, source_path string, page int, text string, error string",
    )
    good, errors = files.page_scan(rows, 5)
    assert [r.page for r in good.collect()] == [2] and [r.error for r in errors.collect()] == ["g: bad"]


def test_store_replaces_only_given_books(spark, tmp_path):
    parsed = store.DocumentStore(spark, str(tmp_path))
    parsed.save("documents", spark.createDataFrame([("a", "1"), ("b", "1")], "textbook_id string, title string"))
    parsed.save("documents", spark.createDataFrame([("b", "2"), ("", "x")], "textbook_id string, title string"))
    assert {(r.textbook_id, r.title) for r in parsed.load("documents").collect()} == {("a", "1"), ("b", "2")}
    assert parsed.exists("a") and not parsed.exists("c")


def test_store_roundtrip_cuts_what_it_stored(spark, sf, monkeypatch):
    from folioscope.plans.segments import store_roundtrip

    whole = store_roundtrip(spark, sf).select("chunk_id").distinct().count()
    load = store.DocumentStore.load

    def half(self, table, key=None):
        rows = load(self, table, key)
        return rows.filter(F.crc32("chapter_id") % 2 == 0) if table == "chapters" else rows

    monkeypatch.setattr(store.DocumentStore, "load", half)
    found = store_roundtrip(spark, sf).select(F.regexp_extract("chunk_id", "_(d[0-9]+)_", 1).alias("chapter_id")).distinct()
    assert whole > 0 and found.count() > 0 and found.filter(F.crc32("chapter_id") % 2 != 0).isEmpty()


def test_legacy_index_layout(spark, tmp_path):
    root = str(tmp_path)
    for name in ("chunks", "vocab", "meta"):
        spark.createDataFrame([("c",)], "chunk_id string").write.parquet(f"{root}/{name}")
    spark.createDataFrame([("t2", "c", 0.8), ("t1", "c", 0.6)], "term string, chunk_id string, weight double").write.parquet(f"{root}/postings")
    row = store.load_index(spark, root)["vectors"].first()
    assert row.terms == ["t1", "t2"] and row.weights == [0.6, 0.8]


def test_questions_and_corpus(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"id": "q1", "question": "x", "expected_keywords": ["a"]}, {"id": "q2", "question": "y"}]))
    assert store.read_questions(spark, str(path)).count() == 2
    book = {"textbook_id": "b", "title": "T", "filename": "f", "chapters": [], "pages": [{"page": 3, "text": "z" * 30}, {"page": 4, "text": "short"}]}
    (tmp_path / "parsed").mkdir()
    (tmp_path / "parsed" / "b.json").write_text(json.dumps(book))
    rows = store.eval_corpus(*store.read_parsed(spark, str(tmp_path / "parsed"))).collect()
    assert [(r.source_id, r.chapter, r.page_start) for r in rows] == [("b:page_3", "page", 3)]


def test_ingest_adds_unseen_only_and_survives_a_rerun(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "chunks")
    schema = "doc_id string, text string"

    def run(checkpoint):
        docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        st.ingest(docs, table, str(tmp_path / checkpoint)).awaitTermination()
        return spark.read.parquet(table)

    spark.createDataFrame([("a", "# T\nfirst"), ("b", "second")], schema).coalesce(1).write.json(source)
    assert run("one").count() == 2
    spark.createDataFrame([("a", "# T\nchanged"), ("c", "third")], schema).coalesce(1).write.mode("append").json(source)
    rows = {r.chunk_id: r.text for r in run("one").collect()}
    assert rows == {"a_ch_001_c1": "first", "b_ch_001_c1": "second", "c_ch_001_c1": "third"}
    # a new checkpoint replays every batch over the same table
    assert {r.chunk_id for r in run("two").collect()} == set(rows)


def test_feedback_stream_equals_batch_with_duplicates(spark, tmp_path, sf):
    from folioscope.plans.knowledge import _elements, feedback_log

    events = spark.read.parquet(f"{sf}/events.parquet")
    source = str(tmp_path / "events")
    events.repartition(5).write.parquet(source)
    events.filter("event_type = 'click'").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    table = str(tmp_path / "folds")
    sf_stream.follow(feedback_log(stream), table, str(tmp_path / "cp")).awaitTermination()
    kept = [*fb.TARGET, "status", "note"]
    got = sf_stream.current_state(spark, _elements(spark, sf), table).select(*kept)
    want = fb.apply_feedback(_elements(spark, sf), feedback_log(events)).select(*kept)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.filter(F.col("status") != "normal").count() > 0


def test_keyed_stream_takes_late_and_repeated_actions_and_restarts(spark, tmp_path):
    from folioscope.streaming import keyed

    schema = "graph_id string, seq long, target_type string, target_id string, action string, comment string, ts timestamp"
    source, table, checkpoint = (str(tmp_path / name) for name in ("log", "states", "checkpoint"))
    elements = spark.createDataFrame(
        [("g", "node", "n1", "normal", None), ("g", "node", "n2", "normal", None), ("g", "edge", "e1", "normal", None)],
        "graph_id string, target_type string, target_id string, status string, note string",
    )

    def send(*rows):
        named = [("g", seq, *target, action, comment, f"2024-01-01 {at}") for seq, target, action, comment, at in rows]
        df = spark.createDataFrame(named, schema.replace("timestamp", "string"))
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        keyed.follow_keyed(log, table, checkpoint).awaitTermination()

    n1, n2, e1 = ("node", "n1"), ("node", "n2"), ("edge", "e1")
    send((2, n1, "edit", "second", "10:10:00"), (4, n2, "delete", "", "10:20:00"), (2, n1, "edit", "second", "10:10:00"))
    send((1, n1, "merge", "first", "10:00:00"), (2, n1, "edit", "second", "10:10:00"), (5, e1, "keep", "x", "10:30:00"))  # late, repeated
    send((9, n2, "keep", "far", "20:00:00"))  # a restart; the watermark moves on
    send((3, n1, "delete", "", "10:15:00"), (10, e1, "delete", None, "20:01:00"))  # the first one is too late
    states = {r.target_id: r for r in keyed.keyed_states(spark, table).collect()}
    assert (states["n1"].status, states["n1"].note, states["n1"].actions) == ("updated", "second", 2)
    assert (states["n2"].status, states["n2"].note, states["n2"].status_seq) == ("updated", "far", 9)
    taken = [(1, n1, "merge", "first"), (2, n1, "edit", "second"), (4, n2, "delete", ""), (5, e1, "keep", "x"), (9, n2, "keep", "far"), (10, e1, "delete", None)]
    log = spark.createDataFrame([("g", seq, *t, a, c) for seq, t, a, c in taken], schema.rsplit(",", 1)[0])
    got = keyed.current_state(elements, keyed.keyed_states(spark, table))
    want = fb.apply_feedback(elements, log).select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    before = spark.read.parquet(table).count()
    log = spark.readStream.schema(schema).parquet(source)
    keyed.follow_keyed(log, table, checkpoint).awaitTermination()  # nothing new
    assert spark.read.parquet(table).count() == before


def test_files_whose_ids_are_equal_stay_apart(spark, tmp_path):
    """Ids hold 20 characters of a name; the whole path tells files apart."""
    for name, body in (("introduction_to_pathology_vol1.md", "first"), ("introduction_to_pathology_vol2.md", "second")):
        (tmp_path / name).write_text(f"# One\n{body} text that is long enough\n# Two\n{body} more\n")
    found = files.list_files(spark, str(tmp_path), "*.md")
    documents, chapters = files.parse_files(found)
    assert documents.select("textbook_id").distinct().count() == 1
    listed = catalog.catalogue([found.select("path", "filename")], documents.withColumns({"total_pages": F.lit(1), "chapter_count": F.lit(2)}))
    assert {r.title for r in listed.collect()} == {r.title for r in documents.collect()} and listed.count() == 2
    chapters = chapters.withColumns({"page_start": F.lit(1), "page_end": F.lit(1)})
    cut, errors = ck.chapter_chunks(documents, chapters, documents.select("textbook_id"))
    rows = cut.collect()
    assert len(rows) == len({r.chunk_id for r in rows}) == 4 and errors.count() == 0
    assert all(("first" in r.text) == ("vol1" in r.source_file) for r in rows)
    parsed = store.DocumentStore(spark, str(tmp_path / "store"), key="path", buckets=4)
    parsed.save("chapters", chapters)
    one = chapters.filter(F.col("path").contains("vol1"))
    parsed.save("chapters", one.withColumn("title", F.lit("new")).limit(1))
    assert sorted(r.title == "new" for r in parsed.load("chapters").collect()) == [False, False, True]
    path = one.first().path
    assert "PartitionFilters: [isnotnull(bucket" in parsed.load("chapters", path)._jdf.queryExecution().toString()
    assert parsed.load("chapters", path).count() == 1


def test_parsed_files_may_leave_things_out(spark, tmp_path):
    long = "word " * 8
    given = {
        "a b.json": {"chapters": [{"text": long, "page": 7}, {"title": "T", "content": long, "page_start": 2, "page_end": 3}, {"text": "short"}]},
        "b.json": {"textbook_id": "", "textbook": "Book", "pages": [{"content": long}, {"page_number": 9, "text": long, "chapter_id": "own"}]},
        "c.json": {"textbook_id": "same", "title": "C", "chapters": [{"chapter_id": "x", "content": long + "c"}]},
        "d.json": {"textbook_id": "same", "title": "D", "chapters": [{"chapter_id": "x", "content": long + "d"}]},
    }
    for name, content in given.items():
        (tmp_path / name).write_text(json.dumps(content))
    (tmp_path / "e.json").write_text("{ no json")
    rows = store.eval_corpus(*store.read_parsed(spark, str(tmp_path))).collect()
    got = {(r.source_id, r.book, r.filename, r.chapter, r.chapter_id, r.page_start, r.page_end) for r in rows}
    assert len(rows) == 6 and got == {
        ("a b:ch_001", "a b", "a b.json", "ch_001", "ch_001", 7, 7),
        ("a b:ch_002", "a b", "a b.json", "T", "ch_002", 2, 3),
        ("b:page_1", "Book", "b.json", "page", "page_1", 1, 1),
        ("b:page_9", "Book", "b.json", "page", "own", 9, 9),
        ("same:x", "C", "c.json", "x", "x", None, None),
        ("same:x", "D", "d.json", "x", "x", None, None),
    }
    assert {r.text[-1] for r in rows if r.textbook_id == "same"} == {"c", "d"} and all(r.source_path for r in rows)


def test_seen_ids(spark, tmp_path):
    from folioscope.streaming.seen import SeenIds

    def frame(low, high):
        return spark.range(low, high).select(F.concat(F.lit("id"), "id").alias("id"))

    seen = SeenIds(spark, str(tmp_path / "seen"), buckets=8)
    assert seen.known(frame(0, 5), 0).count() == 0
    seen.add(frame(0, 300), 0)
    seen.add(frame(250, 400), 1)
    assert sorted(r.id for r in seen.known(frame(390, 420), 2).collect()) == sorted(f"id{i}" for i in range(390, 400))
    # its own batch doesn't count, so a replay finds what the first run found
    assert seen.known(frame(300, 400), 1).count() == 0 and seen.known(frame(240, 310), 1).count() == 60
    # filters reject nearly all ids that were never seen
    assert seen.suspects(frame(10_000, 11_000), 2).count() < 20
    plan = seen._read("ids", "id string", 2).filter(F.col("bucket").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan
    before = spark.read.parquet(str(tmp_path / "seen/ids")).count()
    seen.add(frame(250, 400), 1)
    assert spark.read.parquet(str(tmp_path / "seen/ids")).count() == before


def test_results_are_whole(spark, tmp_path, sf):
    from folioscope.operators import evaluate as ev
    from folioscope.plans import corpus as cp

    docs, questions = cp.eval_docs(spark, sf), cp.questions(spark, sf).limit(5)
    contexts, times = ev.evaluate_timed(docs, questions)
    names = ["baseline_medium", "small_only", "small_to_big"]
    rows = ev.question_metrics(contexts, questions, names)
    root = str(tmp_path / "results")
    summary = ev.strategy_summary(rows, times)
    store.write_results(root, ev.nested_results(rows, contexts, questions, times), summary, store.run_metadata(docs, questions))
    counts = {r.strategy: r["count"] for r in contexts.groupBy("strategy").count().collect()}
    for r in times.collect():
        assert r.contexts == counts[r.strategy] and r.questions == 5 and r.avg_latency_ms == r.job_ms / 5 > 0 and r.chunks > 0
    back = spark.read.json(f"{root}/raw_results").collect()
    assert len(back) == 15 and all([c["rank"] for c in r.contexts] == sorted(c["rank"] for c in r.contexts) for r in back)
    assert all(len(c.snippet) <= 280 and c.text.startswith(c.snippet) for r in back for c in r.contexts) and back[0].latency_ms > 0
    about = spark.read.json(f"{root}/metadata").first()
    assert about.question_count == 5 and [s.name for s in about.strategies] == names and about.vectorizer.analyzer == "char_wb"
    header = spark.read.option("header", True).csv(f"{root}/results").columns
    assert header[:5] == ["strategy", "hit_at_5", "keyword_recall", "context_chars", "avg_latency_ms"] and len(header) == 8
    lines = [r.value for r in spark.read.text(f"{root}/results_table").collect()]
    assert len(lines) == 5 and all(line.count("|") == 9 for line in lines)
    assert store.summary_table(ev.strategy_summary(rows)).first().value.split("\n")[0].count("|") == 8
    paths = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "source_path string")
    assert [r.source_path for r in store.source_paths(paths).collect()] == ["a"]


def test_stream_of_a_table_in_a_folder_of_files(spark, tmp_path):
    from folioscope.plans import corpus as cp
    from folioscope.plans.segments import stream_ingest

    rows = spark.createDataFrame([(n, f"Some words of text {n}") for n in range(6)], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.table_stream(spark, str(tmp_path), "documents").isStreaming
    assert stream_ingest(spark, str(tmp_path)).count() == 6
