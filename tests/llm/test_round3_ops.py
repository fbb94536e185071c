"""Ranked search, token files and phrases against brute force, SQL and the tokenizer itself."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from folioscope.llm import lexical, near, phrases, wavelet
from tests.llm.conftest import LONG, ODD
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_phrases"])
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, name, sf_dir):
    assert difference(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name]) is None


# ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ranked_by_hand(docs, items, k):
    terms = [(doc_id, Counter(TERM.findall(lowered(text)))) for doc_id, text in docs]
    terms = [(doc_id, counts, sum(counts.values())) for doc_id, counts in terms if counts]
    n_docs, n_terms = len(terms), sum(n for *_, n in terms)
    df = Counter(t for _, counts, _ in terms for t in counts)
    rows = []
    for item_id, text in items:
        found = []
        for doc_id, counts, n in terms:
            m, score = 75 + 25 * n * n_docs // n_terms, 0
            for term in TERM.findall(lowered(text)):
                if term in counts:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += weight * (1_000_000_000 * counts[term] // (1000 * counts[term] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        rows += [(item_id, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(rows, key=str)


def found(index, items, k):
    return sorted([tuple(r) for r in lexical.search(index, items, k).collect()], key=str)


def test_search_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 3)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 70)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 12)
    random.seed(5)
    words = ["a", "B", "c1", "dé", "中", "e", "ff", "g", "h", "i"]
    docs = [
        (random.randint(1, 400), " ,".join(random.choices(words, weights=range(1, 11), k=random.choice([0, 1, 3, 9, 40]))))
        for _ in range(300)
    ]
    docs += [(None, "a a a"), (None, "a a a"), (7, "a a a"), (500, None), (501, "x" * 300 + " " + "g " * 3000)]
    items = [(i, " ".join(random.choices(words + ["none"], k=random.randint(0, 6)))) for i in range(12)] + [(99, None)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 4, 1000):
        assert found(index, asked, k) == ranked_by_hand(docs, items, k)


def test_search_odd(spark, odd, nothing):
    items = [(1, "alpha Beta x中文"), (2, "w1x1 w2x2"), (3, "")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(lexical.build_index(odd), asked, 20) == ranked_by_hand([r[:2] for r in ODD], items, 20)
    assert found(lexical.build_index(nothing), asked, 20) == []
    assert found(lexical.build_index(odd), asked.limit(0), 20) == []


def test_blocks_are_rejected_before_decompression():
    shard = lexical._Shard()
    shard.add(list(range(3000)), [b"common " * (1 if i else 50) + b"rare " * (i % 1000 == 7) for i in range(3000)])
    measure = np.full(3000, 100)
    rows = [r for b in shard.batches(0) for r in b.to_pylist() if r["term"]]
    lists = {r["term"]: lexical._List(r["df"], r["directory"], r["data"], measure, lambda n: np.full(len(n), 100)) for r in rows}
    bar = 2 * lists["common"].bound
    docs, scores = lexical.max_score([(1, lists["common"]), (5, lists["rare"])], 3000, 3, bar)
    assert docs.tolist() == [7, 1007, 2007] and len(set(scores.tolist())) == 1
    assert lists["rare"].have.all() and lists["common"].have.sum() == 3 < len(lists["common"].blocks)
    assert len(lexical.max_score([(1, lists["common"])], 3000, 3, bar)[0]) == 0


def test_variable_length_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**31, 5])
    packed, sizes = lexical.to_bytes(values)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 3, 4, 5, 1] and lexical.from_bytes(packed).tolist() == values.tolist()


# token files


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    return path, lambda text: whole.encode(text or "", add_special_tokens=False).ids


def by_hand(rows, encode):
    """{doc_id: (start, ids)} where ids are unique and not null."""
    out, start = {}, 0
    for doc_id, text in sorted(rows):
        out[doc_id] = (start, encode(text) + [0])
        start += len(out[doc_id][1])
    return out


def test_token_files_query(spark, sf, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = by_hand(docs, tokenizer[1])
    got = {r.doc_id: r for r in entry.queries()["op12_token_files"](spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, (start, ids) in want.items():
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), crc)


def test_encoder_equals_tokenizer(tokenizer):
    random.seed(3)
    encoder = wavelet.SharedEncoder(tokenizer[0]).get()
    parts = ["a", "don't", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "'S", "12", "é", "中", "😀"]
    parts += ["<|endoftext|>", "!", "..", "ª", "ǆ", "́", "hello", "_", "$$$", "\x00"]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert np.frombuffer(encoder.ids(text), "<u2").tolist() == tokenizer[1](text), text


def test_long_texts_are_cut_safely(tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet, "PART", 50)
    monkeypatch.setattr(wavelet, "CACHED", 5)
    encoder = wavelet.SharedEncoder(tokenizer[0]).get()
    for text in (LONG[:5000], "x" * 300, " " * 200, "ab \n cd  \n\n" * 40, LONG[:400] + "  " * 60 + "end"):
        assert np.frombuffer(encoder.ids(text), "<u2").tolist() == tokenizer[1](text)


@pytest.mark.parametrize("n", [0, 1, 7, 65_536, 200_000])
def test_wavelet_matrix(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.4, n) - 1, 999).astype(np.uint16)
    content = wavelet.compress(ids, 10, [None, 4], np.array([0, n // 2, n]))
    reads = []
    matrix = wavelet.WaveletMatrix(lambda at, size: reads.append(size) or content[at : at + size])
    assert (matrix.all() == ids).all() and matrix.known.tolist() == [False, True]
    places = np.arange(n)[:: max(1, n // 500)]
    assert (matrix.access(places) == ids[places]).all()
    for token in (0, 1, 5, 998, 999, 1023, 70_000):
        where = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(where) and (matrix.select(token) == where).all()
        assert matrix.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
    if n == 200_000:
        reads.clear()
        one = wavelet.WaveletMatrix(lambda at, size: reads.append(size) or content[at : at + size])
        assert one.access(np.array([77])) == ids[77] and sum(reads) < len(content) / 2  # a block per plane
    with pytest.raises(IndexError):
        matrix.select(0, np.array([n + 1]))


def test_token_files_odd(spark, odd, nothing, tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD", 40)
    files = wavelet.write_tokens(odd, tokenizer[0])
    got = files.documents(lambda ids: ids.tolist(), "ids", "array<long>").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9] and files.shards.count() > 2
    rows = sorted(((r[0] or -1, tokenizer[1](r[1]) + [0]) for r in ODD), key=lambda r: r[0])
    assert sorted((r.doc_id or -1, r.ids) for r in got) == sorted(rows)
    assert [r.start for r in got] == [sum(len(r.ids) for r in got[:i]) for i in range(len(got))]
    token = tokenizer[1](" beta")[0]
    want = sorted((r.doc_id, i) for r in got for i, t in enumerate(r.ids) if t == token)
    assert sorted((r.doc_id, r["at"]) for r in files.occurrences([token, 0]).filter(f"token = {token}").collect()) == want
    assert {r.token: r.n for r in files.counts([token, 0]).collect()} == {token: len(want), 0: sum(t == 0 for r in got for t in r.ids)}
    again = wavelet.write_tokens(odd.repartition(5), tokenizer[0], files.folder)  # same rows, same files
    assert again.documents(wavelet.ids_crc32, "c", "long").count() == len(ODD)
    empty = wavelet.write_tokens(nothing, tokenizer[0])
    assert empty.documents(wavelet.ids_crc32, "c", "long").count() == 0


# phrases


def phrases_by_hand(docs, least, top):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    rows = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()
            )
            if not inside:
                cuts = [(1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(rows)


def test_phrases_by_hand(spark, monkeypatch):
    for name, value in (("SLICE", 200), ("HELD_CELLS", 100), ("MERGED_CELLS", 20), ("HOT", 3)):
        monkeypatch.setattr(phrases, name, value)
    random.seed(9)
    words = ["a", "B", "c", "Dé", "É", "e f", "g\x1ch", "中"]
    marks = [" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " !"]

    def text():
        return "".join(random.choice(words) + random.choice(marks) for _ in range(random.randint(0, 30)))

    docs = [(random.choice(["x", "x", None, "und", "y"]), text()) for _ in range(150)]
    docs += [("x", None), ("x", ""), (None, "the same line of five words. " * 50), ("z", ",,, . \n"), ("y", "w " * 300)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    for least, top in ((2, 10_000), (6, 5)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, top=top).collect())
        assert got == phrases_by_hand(docs, least, top)


def test_phrases_odd(spark, odd, nothing):
    got = sorted(tuple(r) for r in phrases.collocations(odd, least=2, top=50).collect())
    assert got == phrases_by_hand([(r[2], r[1]) for r in ODD if r[1] is not None], 2, 50)
    assert phrases.collocations(nothing).collect() == []


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(10**13, 10**13, 10**6, 10**6)], "a long, n long, l long, r long")
    got = row.select(phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).first().s
    assert got == 1000 * 10**26 // 10**12


# decontamination: items of mixed length, other scripts


def test_short_texts_between_each_other(spark):
    from folioscope.llm import contamination

    random.seed(4)
    short = "a short benchmark item of some words"
    long = " ".join(f"w{random.randint(0, 9999)}" for _ in range(1000))
    edited = short.replace("short", "shirt")
    bench = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, short), (2, edited), (3, short), (4, "nothing of the kind")], "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in contamination.drop_contaminated(docs, bench).collect()) == [4]


def test_case_and_blanks_of_all_scripts(spark):
    from folioscope.llm import contamination

    bench = spark.createDataFrame([(1, "Съешь же ещё этих мягких булок"), (2, "ξεσκεπάζω την ψυχοφθόρα σας")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x СЪЕШЬ ЖЕ ЕЩЁ ЭТИХ МЯГКИХ БУЛОК y"), (2, "ξεσκεπάζω την　 ψυχοφθόρα ΣΑΣ"), (3, "съел")], "doc_id long, text string"
    )
    found = contamination.drop_contaminated(docs, bench)
    assert [r.doc_id for r in found.collect()] == [3]


def test_near_sends_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)

    def noted(df, *a):
        seen.append(int(spark.conf.get(name)))
        return staged(df, *a)

    staged = near.stage
    monkeypatch.setattr(near, "stage", noted)
    docs = spark.createDataFrame([(i, "a b c d e f") for i in range(3)], "doc_id long, text string")
    assert {r.component_id for r in near.near_duplicates(docs, words=2).collect()} == {0}
    assert seen and max(seen) <= near.BATCH and spark.conf.get(name) == before
