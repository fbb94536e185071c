"""Operators whose results are fixed by their definition, against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioscope.llm import bpe, chat, exact, near, pii, substring
from tests.llm.conftest import LONG, ODD
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", ["op1_chat_format", "op6_exact_dedup"])
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, name, sf_dir):
    assert difference(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name]) is None


def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# chat


def test_turns_read_back():
    random.seed(1)
    parts = ["\\", "#", "##", "###", "</turn>", "</turn", ">", " ", "\n", "User", ":", ": ", "### Assistant: ", "é"]
    for _ in range(5000):
        role = random.choice(["user", "assistant", "User", "x:y", "", "\\", "###", "a\nb", "x: "])
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 9)))
        made, start, end = chat.render(role, text)
        assert chat.read(made) == (role, text, len(made))
        following = chat.render("user", text[::-1])[0]
        assert chat.read(made + following, len(made))[:2] == ("user", text[::-1])


def test_conversations_odd(spark):
    rows = [(1, 1, None, None, "z"), (1, None, "user", "a", "z"), (None, 1, "assistant", "b", "z"), (2, 1, "user", "", "z"),
            (2, 1, "user", "", "z"), (3, 1, "assistant", LONG + " </turn>", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    turns = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, None: 1, 2: 2, 3: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\n\n\n").hexdigest()
    assert got[3].loss_chars == len(LONG) + 8
    whole = {r.conv_id: r for r in chat.conversations(turns).collect()}
    assert all(len(whole[k].formatted) == r.formatted_chars for k, r in got.items())
    assert [whole[None].formatted[s.start : s.end] for s in whole[None].loss] == ["b"]
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# exact dedup


def test_exact_odd(spark, odd, nothing):
    got = exact.exact_groups(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert by_id[6].keep_id == 1 and not by_id[6].kept and by_id[1].group_size == 2
    assert by_id[2].keep_id == 2 and by_id[3].keep_id == 2 and by_id[3].group_size == 3
    assert by_id[4].keep_id == 4  # one space is not nothing
    kept = exact.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 7, 8, 9]
    assert exact.exact_groups(nothing).count() == 0 and exact.keep_first(nothing).count() == 0


# near dedup


def components_of(rows, words, percent):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for key in sorted(sets):
        shared = {}
        for shingle in sets[key]:
            for other in where.setdefault(shingle, []):
                shared[other] = shared.get(other, 0) + 1
            where[shingle].append(key)
        for other, n in shared.items():
            if 100 * n >= percent * (len(sets[key]) + len(sets[other]) - n):
                a, b = find(key), find(other)
                root[max(a, b)] = min(a, b)
    return {key: (len(sets[key]), find(key)) for key in sets}


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_near_components(spark, sf_dir):
    want = components_of(texts(spark, sf_dir).items(), 2, 80)
    got = {r.doc_id: r for r in entry.queries()["op10_near_dedup"](spark, sf_dir).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_chain_across_leaders(spark):
    """Drifting copies: links between documents that a bucket's smallest is not linked with."""
    random.seed(5)
    rows, words = [], [f"t{i}" for i in range(60)]
    for key in range(160):
        rows.append((key, " ".join(words)))
        words[random.randrange(60)] = f"n{key}"
    random.shuffle(rows)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components_of(rows, 1, 80)


def test_near_odd(spark, odd, nothing):
    rows = near.near_duplicates(odd).collect()
    got = {r.doc_id: r for r in rows if r.doc_id}
    assert len(rows) == len(ODD)
    assert got[6].component_id == 1 and got[8].component_id == 5 and got[2].n_shingles == 0 and got[2].kept
    kept = near.keep_representatives(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    assert near.near_duplicates(nothing).count() == 0


# substring dedup


def repeats(rows, window=20):
    seen, out = set(), {}
    for key, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                gone[i : i + window] = [True] * window
            seen.add(run)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[key] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_substring_query(spark, sf_dir):
    got = entry.queries()["op2_substring_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == repeats(texts(spark, sf_dir).items())


@pytest.mark.parametrize("hot", [3, 10**6])
def test_substring_periodic_and_hot(spark, hot):
    random.seed(2)
    rows = [(i, " ".join(random.choice("abc") for _ in range(random.randint(0, 90)))) for i in range(60)]
    rows += [(100 + i, " ".join(["ab", "cd", "ef"][: i + 1] * 30)) for i in range(3)] + [(200, LONG), (201, LONG)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    found = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got}
    assert found == repeats(rows)


def test_substring_factors_copy_their_source(spark):
    rows = [(1, LONG), (2, "before " + LONG + " after")]
    text = dict(rows)
    for f in substring.factors(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        size = f.length + 19
        if f.source_id != f.doc_id:
            own, source = text[f.doc_id].split(), text[f.source_id].split()
            assert own[f.start : f.start + 20] == source[f.source_start : f.source_start + 20] and size >= 20


def test_substring_odd(spark, odd, nothing):
    got = substring.remove_repeats(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert by_id[2].n_words == 0 and by_id[2].kept_text == "" and by_id[8].n_removed >= 59_000
    assert substring.remove_repeats(nothing).count() == 0


# byte-level BPE


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = bpe.read_ranks(path)
    codec = bpe.Codec(ranks, pattern)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})
    random.seed(3)
    tokens = [t.decode("utf-8", "ignore") for t, _ in ranks]
    cases = ["", " ", "  ", "a  b", "a   b ", "\n\n x", "a \n b", LONG, "ab" * 20_000, "   x", "don't  I'll"]
    cases += ["".join(random.choice(tokens) for _ in range(random.randint(1, 8))) for _ in range(3000)]
    cases += ["".join(random.choice("aabtheinger  éü中😀\n\t1.") for _ in range(random.randint(0, 40))) for _ in range(3000)]
    cases += [t for t in texts(spark, "/root/testdata/sf0.001").values()]
    for text in cases:
        ids = codec.encode(text)
        assert ids == own.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_query(spark):
    import tiktoken

    path, pattern = bpe.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(bpe.read_ranks(path)), special_tokens={})
    source = texts(spark, "/root/testdata/sf0.001")
    for r in entry.queries()["op8_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = own.encode_ordinary(source[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(source[r.doc_id].encode()).hexdigest()


def test_bpe_odd(spark, odd, nothing, tables):
    path, pattern = bpe.vocabulary()
    done = bpe.decode(bpe.encode(odd, path, pattern), path)
    assert set(odd.columns) < set(done.columns)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in done.collect())
    assert bpe.encode(nothing, path, pattern).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    rows = entry.queries()["op8_byte_bpe"](spark, tables(documents=odd)).collect()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (2, 3)} == {(0, empty, empty)}


def test_bpe_one_pass_equals_two(spark, odd):
    """The bytes may take the text's place; clashing columns are replaced, all others stay."""
    path, pattern = bpe.vocabulary()
    clash = odd.withColumns({"ids": F.lit("x"), "decoded": F.lit(1)})
    once = bpe.encode(clash, path, pattern, decoded="text")
    assert sorted(once.columns) == sorted(clash.columns)
    assert [f.dataType.simpleString() for f in once.schema if f.name in ("ids", "text")] == ["array<int>", "binary"]
    twice = bpe.decode(bpe.encode(odd, path, pattern), path)
    rows = sorted((str(r.doc_id), list(r.ids), bytes(r.text)) for r in once.collect())
    assert rows == sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in twice.collect())
    assert all(r.decoded == 1 for r in once.collect())
    lists = spark.createDataFrame([([64, 65],), (None,), ([],)], "ids array<int>")
    assert [len(r.decoded) > 0 for r in bpe.decode(lists, path).collect()] == [True, False, False]


def test_bpe_cuts_batches_and_forgets(monkeypatch):
    """Slices cover a batch whole; a full memory keeps what is asked for again and stays bounded."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "SLICE_BYTES", 10)
    values = ["a" * 25, None, "", "bcd", "e" * 9, "f"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(values, pa.string())})
    slices = list(bpe._slices(batch, "text"))
    assert len(slices) > 1 and [v for s in slices for v in s.column(0).to_pylist()] == values

    made = []
    memory = bpe.Remembered(lambda key: made.append(key) or key * 2, 3, lambda key: key != 99)
    for key in (1, 2, 3, 1, 4, 1, 5, 6, 1, 99, 99):
        assert memory[key] == key * 2
        assert len(memory) <= 3 and len(memory.old) <= 3 and 99 not in memory
    assert made == [1, 2, 3, 4, 5, 6, 99, 99]


# personal data


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(found):
    return re.sub("[^0-9]", "", found)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def base_spans(text):
    found = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, valid) in enumerate(BASE)
        for m in re.finditer(pattern, text or "")
        if valid(m[0])
    ]
    return sorted(found)


def check_pii(rows, source):
    for r in rows:
        want = base_spans(source[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == b[0] for w in want) for b in BASE]
        listed = [f"{kind}:{start}:{end}" for start, _, end, kind in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",") if r.spans else [])


def test_pii_query(spark):
    source = texts(spark, "/root/testdata/sf0.01")
    check_pii(entry.queries()["op9_pii"](spark, "/root/testdata/sf0.01").collect(), source)


def test_pii_made_up(spark, tables):
    random.seed(3)
    parts = ["1", "2", "255", "256", "0", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "4111111111111111", "é", "😀", "%",
             "12 34 56", "+1 (212) 555-0100", "a@b.co", "1.2.3.4", "\n"]
    source = {i: "".join(random.choice(parts) for _ in range(random.randint(0, 14))) for i in range(2000)}
    source |= {5000: "1 " * 30_000, 5001: "9" * 60_000, 5002: "a." * 30_000, 5004: None, 5005: "+1 " * 9_000, 5006: "x@" * 9000}
    docs = spark.createDataFrame(list(source.items()), "doc_id long, text string")
    check_pii(entry.queries()["op9_pii"](spark, tables(documents=docs)).collect(), source)


def test_pii_added_and_redacted(spark, odd, nothing):
    text = "pay DE89 3704 0044 0532 0130 00 or call 212-555-0100; not 213-555-0100 at all, nor DE89 3704 0044 0532 0130 01"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.find_spans(df).first().spans
    assert [(s.kind, s.value) for s in spans][:2] == [("iban", "DE89 3704 0044 0532 0130 00"), ("local_phone", "212-555-0100")]
    assert [s.kind for s in spans].count("iban") == 1
    assert pii.redact(df).first().redacted.startswith("pay <iban> or call <local_phone>; not ")
    found = pii.find_spans(odd)
    assert found.count() == len(ODD) and set(found.columns) == set(odd.columns)
    assert all(r.redacted == (r.text or "") for r in pii.redact(odd).collect())
    assert pii.find_spans(nothing).count() == 0
