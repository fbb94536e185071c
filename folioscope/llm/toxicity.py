"""Toxicity by weak supervision.

Voters are words and patterns: a fixed list of insults, the words and beginnings of words that the
labelled rows tie most to the label, and a few signs of shouting.  A voter votes where it occurs.  A
generative model takes the votes as noisy signs of a hidden label.  Counts of votes and of pairs of
votes come from all rows, labelled or not.  Given the hidden label, independent voters have
correlations that are products of their own with it, so triples of voters give each one's accuracy; a
voter without triples is measured by the given label, over all labelled rows.  What the products leave
over is the correlation of a pair, and correlated voters share one voice.  The
model's posterior labels then train a linear classifier over hashed words and votes, whose scale is set
on the labelled rows.

Labels are read only from rows for which the caller allows it.  The classifier and the scale use at most
`sample` labelled rows, those with the smallest hash of their id; the word voters come from all labelled
rows, and all else covers all rows.  Language, source and id are no inputs of a score.

Null text is empty; an empty text has the score of no evidence.  Labels of unknown rows and null labels
are ignored; without any usable label the fixed voters and a prior of one tenth remain.  Repeated rows
score alike.  Extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import WordHash, free_name, query, remainder, table, text_bytes
from folioscope.session import stage

SAMPLE = 20_000  # greatest number of labelled rows for classifier and scale
HELD = 300_000  # counts that a task holds before it puts them out
SHARED = 0.6  # of the rows of one word that another may have
LEAST_STRENGTH = 16.0  # log likelihood ratio; less is expected by chance among very many words
LEAST_ROWS = 5  # labelled rows with a word before it may vote
BUCKETS = 1 << 16  # of the classifier's words
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word that stand for its inflected forms
THRESHOLD = 0.3
PRIOR = 0.1
UNSEEN = 2.0  # weight of a fixed insult of which neither the rows nor the labels tell
CLOSE = 0.05  # correlation from which two voters make a triple with the label
DEPENDENT = 0.2  # correlation left over by the model from which two voters share a voice

# fixed values: insults
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "trash", "garbage", "scum", "loser", "worthless", "pathetic", "disgusting",
    "clown", "imbecile", "fool", "jerk", "bastard", "vermin", "filth", "retard", "bitch", "shit", "fuck", "asshole",
    "crétin", "connard", "salaud", "débile", "ordure",
    "arschloch", "dummkopf", "abschaum", "trottel", "blödmann",
    "imbécil", "estúpido", "basura", "gilipollas", "mierda",
)
PATTERNS = (
    re.compile(rb"!!"),
    re.compile(rb"\b[A-Z]{4,} [A-Z]{4,} [A-Z]{4,}\b"),
    re.compile(rb"\byou (?:are|re) (?:an? |such an? |so )?(?:idiot|moron|stupid|dumb|fool|loser|pathetic|trash)"),
)

_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
REMEMBERED = 150_000  # words of which a task remembers what they vote


def words_of(text: bytes) -> set[bytes]:
    """Distinct words (ASCII signs are blanks, A-Z lower case)."""
    return set(text.translate(_SIGNS).lower().split())


def signs_of(text: bytes) -> set[bytes]:
    """Distinct words and, with a star, their beginnings."""
    words = words_of(text)
    signs = set(words)
    for size in BEGINNINGS:
        signs.update([word[:size] + b"*" for word in words if len(word) > size])
    return signs


class Voters:
    """Words, beginnings, beginnings that two words share, and patterns."""

    def __init__(self, words: list[bytes]):
        self.place = {w: i for i, w in enumerate(words)}
        begins = [w for w in words if w.endswith(b"*")]
        self.twice = {self.place[w]: len(words) + i for i, w in enumerate(begins)}
        self.patterns = len(words) + len(begins)
        self.count = self.patterns + len(PATTERNS)

        self.told: dict[bytes, tuple[list[int], list[int]] | None] = {}

    def _tell(self, word: bytes) -> tuple[list[int], list[int]] | None:
        """Votes of a word and its beginnings, and the beginnings of which it is a form; mostly none."""
        votes = [self.place[word]] if word in self.place else []
        forms = []
        for size in BEGINNINGS:
            sign = word[:size] + b"*"
            if len(word) >= size and sign in self.place:
                forms.append(self.place[sign])
                if len(word) > size:
                    votes.append(self.place[sign])
        if len(self.told) >= REMEMBERED:
            self.told.clear()
        told = self.told[word] = (votes, forms) if votes or forms else None
        return told

    def votes(self, text: bytes, words: set[bytes]) -> list[int]:
        """Voters that vote on a text with these distinct words."""
        found: set[int] = set()
        forms: Counter[int] = Counter()
        told = self.told
        for word in words:
            own = told[word] if word in told else self._tell(word)
            if own:
                found.update(own[0])
                forms.update(own[1])
        found.update([self.twice[at] for at, n in forms.items() if n > 1 and at in found])
        found.update([self.patterns + i for i, pattern in enumerate(PATTERNS) if pattern.search(text)])
        return sorted(found)


def _labelled(labels: DataFrame, id_column: str, allowed: Column) -> DataFrame:
    """All labelled rows: label_id, toxic."""
    rows = labels.filter(allowed & F.col("toxic").isNotNull() & F.col(id_column).isNotNull())
    rows = rows.select(F.col(id_column).cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    return rows.groupBy("label_id").agg(F.max("toxic").alias("toxic"))


def _mined(labelled: DataFrame, positive: int, total: int) -> list[bytes]:
    """Words whose presence tells about the label, by the likelihood ratio statistic; strongest first.

    A word that mostly occurs in the rows of a better one adds no voter: else the words of one much
    copied text would outvote all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter[bytes] = Counter()
        toxic: Counter[bytes] = Counter()

        def put() -> pa.RecordBatch:
            columns = [pa.array(list(every), pa.binary()), pa.array(list(every.values()), pa.int64())]
            columns.append(pa.array([toxic[w] for w in every], pa.int64()))
            return pa.RecordBatch.from_arrays(columns, ["word", "n", "t"])

        for batch in batches:
            for text, label in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                signs = signs_of(text)
                every.update(signs)
                if label:
                    toxic.update(signs)
                if len(every) >= HELD:
                    yield put()
                    every.clear()
                    toxic.clear()
        yield put()

    counts = labelled.select("text", "toxic").mapInArrow(run, "word binary, n long, t long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counts = counts.filter((F.col("t") >= LEAST_ROWS) & (F.col("t") * total > 3 * F.col("n") * positive))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rate = positive / total
    n, t = F.col("n"), F.col("t")
    strength = part(t, n * rate) + part(n - t, n * (1 - rate))
    best = counts.select("word", "t", strength.alias("strength")).filter(F.col("strength") >= LEAST_STRENGTH)
    best = best.orderBy(F.desc("strength"), "word").collect()
    place = {bytes(row.word): i for i, row in enumerate(best)}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter[tuple[int, int]] = Counter()

        def put() -> pa.RecordBatch:
            columns = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
            columns.append(pa.array(list(pairs.values()), pa.int64()))
            return pa.RecordBatch.from_arrays(columns, ["i", "j", "n"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                pairs.update(combinations(sorted(place[w] for w in signs_of(text) & place.keys()), 2))
                if len(pairs) >= HELD:
                    yield put()
                    pairs.clear()
        yield put()

    met = labelled.filter("toxic = 1").select("text").mapInArrow(meet, "i long, j long, n long")
    met = met.groupBy("i", "j").agg(F.sum("n").alias("n"))
    own = labelled.sparkSession.createDataFrame([(i, int(row.t)) for i, row in enumerate(best)], "at long, t long")
    for end in ("i", "j"):
        met = met.join(F.broadcast(own.select(F.col("at").alias(end), F.col("t").alias(f"t_{end}"))), end)
    shared = met.filter(F.col("n") >= SHARED * F.least("t_i", "t_j")).groupBy("i").agg(F.collect_list("j").alias("js"))
    chosen = np.ones(len(best), bool)
    for i, weaker in shared.orderBy("i").toLocalIterator():  # strongest first; never held as a whole
        if chosen[i]:
            chosen[weaker] = False
    return [bytes(row.word) for j, row in enumerate(best) if chosen[j]]


def _moments(docs: DataFrame, voters: Voters) -> tuple[int, np.ndarray]:
    """Rows, and how many of them each pair of voters votes on; one row per pair and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pairs, rows, size = np.zeros((2, 0), np.int64), 0, 0

        def merged() -> np.ndarray:
            key, at, n = np.unique(np.concatenate([pairs[0], *held]), return_inverse=True, return_counts=True)
            n = n + np.bincount(at[: pairs.shape[1]], pairs[1] - 1, len(key)).astype(np.int64)
            return np.stack((key, n))

        def put(rows: int) -> pa.RecordBatch:
            i, j = pairs[0] // voters.count, pairs[0] % voters.count
            columns = [np.append(i, -1), np.append(j, -1), np.append(pairs[1], rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "n"])

        for batch in batches:
            rows += batch.num_rows
            for text in text_bytes(batch.column(0)):
                found = np.array(voters.votes(text, words_of(text)), np.int64)
                if len(found):
                    held.append((found[:, None] * voters.count + found).ravel())
                    size += len(found) ** 2
                if size >= HELD:
                    pairs, held, size = merged(), [], 0
                    if pairs.shape[1] >= HELD:
                        yield put(0)
                        pairs = np.zeros((2, 0), np.int64)
        pairs = merged()
        yield put(rows)

    cells = docs.mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    total, together = 0, np.zeros((voters.count, voters.count))
    for i, j, n in cells:
        if i < 0:
            total = n
        else:
            together[i, j] = n
    return total, together


def _told(labelled: DataFrame, voters: Voters) -> tuple[np.ndarray, np.ndarray]:
    """Per voter, and last for no voter at all, the labelled rows and the toxic ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, voters.count + 1), np.int64)
        for batch in batches:
            for text, label in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                found = voters.votes(text, words_of(text)) or [voters.count]
                counts[0, found] += 1
                counts[1, found] += label
        columns = [pa.array(np.arange(voters.count + 1)), pa.array(counts[0]), pa.array(counts[1])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "n", "t"])

    told = labelled.select("text", "toxic").mapInArrow(run, "i long, n long, t long")
    hits, toxic = np.zeros(voters.count + 1), np.zeros(voters.count + 1)
    for i, n, t in told.groupBy("i").agg(F.sum("n"), F.sum("t")).collect():
        hits[i], toxic[i] = n, t
    return hits, toxic


class LabelModel:
    """Weights of votes for a hidden label.

    Counts of votes and of pairs of votes come from all rows; `hits` and `toxic` count all labelled rows
    by voter, the rows without any vote last.  A voter's link to the hidden label comes from triples of
    voters that go together and aren't dependent.  Voters of different languages never meet; one without
    a triple is measured by the given label, which is one more noisy voter: how well it follows the
    hidden one comes from triples of it and two voters.  A voter that doesn't occur abstains, since no
    text holds the insults of every language; only a text without any vote tells something by it.
    """

    def __init__(
        self, rows: int, together: np.ndarray, prior: float, hits: np.ndarray, toxic: np.ndarray, total: int, positive: int
    ):
        size = len(together)
        rate = np.diag(together) / max(rows, 1)
        spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
        pairs = (together / max(rows, 1) - np.outer(rate, rate)) / np.outer(spread, spread)
        np.fill_diagonal(pairs, 0.0)
        used = np.diag(together) >= LEAST_ROWS
        fixed = np.arange(size) < len(INSULTS)
        close = (pairs > CLOSE) & (together >= LEAST_ROWS)
        if 0 < positive < total:
            own, share = hits[:-1] / total, positive / total
            with_label = (toxic[:-1] / total - own * share) / np.sqrt(
                np.maximum(own * (1 - own), 1e-12) * share * (1 - share)
            )
            told = close & (with_label > CLOSE)[:, None] & (with_label > CLOSE)[None, :]
            triples = np.outer(with_label, with_label)[told] / pairs[told]
            label_link = float(np.sqrt(np.clip(np.median(triples), 0.25, 1.0))) if len(triples) else 1.0
            link = np.clip(with_label / label_link, -0.99, 0.99)
            known = hits[:-1] > 0
            self.silent = np.log((toxic[-1] + 1) / (positive + 2)) - np.log(
                (hits[-1] - toxic[-1] + 1) / (total - positive + 2)
            )
        else:  # the fixed insults are taken to follow the hidden label
            label_link, self.silent = 0.0, -2.0
            link = np.where(fixed, 0.5, 0.0)
            known = np.ones(size, bool)
        # pairs that a common voice explains tell nothing about the label
        close &= pairs - np.outer(link, link) <= DEPENDENT
        by_triples = np.full(size, np.nan)
        for i in np.flatnonzero(used):
            near = np.flatnonzero(close[i])
            both = np.triu(close[np.ix_(near, near)], 1)
            if both.any():
                squares = np.outer(pairs[i, near], pairs[i, near])[both] / pairs[np.ix_(near, near)][both]
                by_triples[i] = min(np.sqrt(np.median(squares)), 0.99)
        found = ~np.isnan(by_triples)
        link = np.where(found, by_triples, link)
        self.label_link, self.link = label_link, link
        dependent = (pairs - np.outer(link, link) > DEPENDENT) & np.outer(used, used)
        np.fill_diagonal(dependent, False)
        voice = 1.0 / (1 + dependent.sum(axis=1))
        reach = link * spread  # covariance with the label over the label's own spread
        on = np.clip(rate + reach * np.sqrt((1 - prior) / prior), 1e-5, 1 - 1e-5)
        off = np.clip(rate - reach * np.sqrt(prior / (1 - prior)), 1e-5, 1 - 1e-5)
        measured = used & (known | found)
        self.weight = np.where(measured, voice * np.log(on / off), np.where(fixed, UNSEEN, 0.0))
        self.bias = float(np.log(prior / (1 - prior)))

    def posterior(self, votes: list[list[int]]) -> np.ndarray:
        logit = np.array([self.bias + (self.weight[v].sum() if v else self.silent) for v in votes])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _features(text: bytes, voters: Voters, hashes: WordHash) -> tuple[np.ndarray, list[int]]:
    words = words_of(text)
    buckets = np.unique((hashes.of(list(words)) % np.uint64(BUCKETS)).astype(np.int32))
    return buckets, voters.votes(text, words)


class Linear:
    """Logistic regression on rows of [words | votes], fitted to posterior labels from the model's weights on."""

    def __init__(self, rows: list[np.ndarray], votes: list[list[int]], model: LabelModel):
        self.weight = np.concatenate((np.zeros(BUCKETS), model.weight))
        self.bias = model.bias + model.silent
        if not len(rows):
            return
        target = model.posterior(votes)
        index = [np.concatenate((r, np.array(v, np.int32) + BUCKETS)).astype(np.int32) for r, v in zip(rows, votes)]
        scale = np.concatenate([self._scale(len(r), len(v)) for r, v in zip(rows, votes)])
        row = np.repeat(np.arange(len(index), dtype=np.int32), [len(i) for i in index])
        flat = np.concatenate(index)
        del index
        # full gradients with momentum; the penalty keeps words below what votes tell
        speed, size = np.zeros_like(self.weight), len(rows)
        for _ in range(150):
            logit = self.bias + np.bincount(row, self.weight[flat] * scale, size)
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
            gradient = np.bincount(flat, error[row] * scale, len(self.weight)) / size + 1e-4 * self.weight
            speed = 0.9 * speed - 2.0 * gradient
            self.weight += speed
            self.bias -= 0.5 * error.mean()

    @staticmethod
    def _scale(words: int, votes: int) -> np.ndarray:
        return np.concatenate((np.full(words, 1 / np.sqrt(words + 1), np.float32), np.ones(votes, np.float32)))

    def logit(self, words: np.ndarray, votes: list[int]) -> float:
        own = self.weight[words].sum() / np.sqrt(len(words) + 1)
        return float(self.bias + own + sum(self.weight[BUCKETS + v] for v in votes))


def _scale(logits: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn logits into probabilities of the label."""
    if not len(toxic) or toxic.min() == toxic.max():
        return 1.0, 0.0
    center, spread = logits.mean(), logits.std() + 1e-9
    x = np.stack(((logits - center) / spread, np.ones(len(logits))), 1)
    beta = np.zeros(2)
    for _ in range(50):  # Newton steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        change = np.linalg.solve(hessian, x.T @ (toxic - p) - 1e-3 * beta)
        beta += np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-8:
            break
    slope = max(float(beta[0] / spread), 1e-6)  # a higher score always means likelier
    return slope, float(beta[1] - center * slope)


class Model:
    """What scoring needs; its size is bounded by the parameters."""

    def __init__(self, voters: Voters, linear: Linear, slope: float, shift: float):
        self.voters, self.linear, self.slope, self.shift = voters, linear, slope, shift

    def score(self, text: bytes, hashes: WordHash) -> float:
        words, votes = _features(text, self.voters, hashes)
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.linear.logit(words, votes) + self.shift, -30, 30))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    id_column: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
) -> Model:
    """Fit on all texts and on the allowed labels (columns `id_column` and toxic; `allowed` is over them)."""
    texts = docs.select(F.col(id_column).cast("long").alias("label_id"), F.col(text).alias("text"))
    labelled = texts.join(_labelled(labels, id_column, allowed), "label_id").dropDuplicates(["label_id"])
    labelled = stage(labelled.select("label_id", "text", "toxic"), "labelled")
    total, positive = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    taken = labelled.select("label_id").orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    sampled = labelled.join(F.broadcast(taken), "label_id")
    fixed = [word.encode() for word in INSULTS]
    mined = _mined(labelled, positive, total) if 0 < positive < total else []
    voters = Voters(fixed + [w for w in mined if w not in set(fixed)])
    rows, together = _moments(docs.select(text), voters)
    prior = min(max(positive / total, 0.001), 0.5) if positive else PRIOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            made = [_features(text, voters, hashes) for text in text_bytes(batch.column(0))]
            columns = [pa.array([m[0].tobytes() for m in made], pa.binary())]
            columns += [pa.array([m[1] for m in made], pa.list_(pa.int32())), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["words", "votes", "toxic", "label_id"])

    features = sampled.select("text", "toxic", "label_id")
    found = features.mapInArrow(run, "words binary, votes array<int>, toxic int, label_id long").toArrow()
    found = found.sort_by("label_id")  # at most `sample` rows of bucket numbers
    words = [np.frombuffer(w.as_buffer(), np.int32) for w in found["words"]]
    votes = found["votes"].to_pylist()
    toxic = np.asarray(found["toxic"]).astype(float)
    model = LabelModel(rows, together, prior, *_told(labelled, voters), total, positive)
    linear = Linear(words, votes, model)
    logits = np.array([linear.logit(w, v) for w, v in zip(words, votes)])
    slope, shift = _scale(logits, toxic)
    return Model(voters, linear, slope, shift)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """`df` with the probability of the label in `out`; a column of that name is replaced."""
    base = df.drop(out) if out in df.columns else df
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            made = [model.score(whole, hashes) for whole in text_bytes(batch.column(at))]
            names = [*batch.schema.names, out]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names)

    return base.mapInArrow(run, base.withColumn(out, F.lit(0.0)).schema)


def drop_toxic(df: DataFrame, labels: DataFrame, allowed: Column, threshold: float = THRESHOLD) -> DataFrame:
    """`df` without the rows whose score reaches the threshold."""
    name = free_name(df, "toxicity")
    return score(df, fit(df, labels, allowed), out=name).filter(F.col(name) < threshold).drop(name)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return score(docs, model, out="score").select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
