"""Chat formatting with a grammar that reads its own output back.

    conversation := turn*
    turn         := "### " name ": " body " </turn>" newline

A control string ("###", "</turn>") counts only after an even number of backslashes; an odd number
makes it text.  Every turn is first rendered as it is and read back by the same deterministic reader
that reads whole conversations.  Where role or text come back changed, one more control string is
escaped in that turn, until the turn is identical.  Escaping doubles the backslashes before a control
string and adds one, so it can always be undone.

Null roles and texts are empty strings.  Turns are ordered by turn, role and text, nulls first, so
repeated rows and ties have one result.  Rows without a conversation id form one conversation.  Extra
columns are left out of the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import query, table

OPEN, CLOSE = "###", "</turn>"
CONTROLS = (OPEN, CLOSE)
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {name: role for role, name in NAMES.items()}
LEARNED = frozenset({"assistant"})  # roles whose texts are under the loss mask

_NAME = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_CONTROL = re.compile(rf"(\\*)({OPEN}|{CLOSE})")
_TAIL = f" {CLOSE}\n"


class Conflict(ValueError):
    """A turn that can't be rendered so that it reads back."""


def _name(role: str) -> str:
    """Name of a role in the header; other roles keep their own name, escaped."""
    if role in NAMES:
        return NAMES[role]
    name = re.sub(r"[\\:#<]", r"\\\g<0>", role)
    return f"\\{name}" if role in ROLES else name


def _role(name: str) -> str:
    return ROLES[name] if name in ROLES else re.sub(r"\\(.)", r"\1", name, flags=re.S)


def escape(text: str, controls: tuple[str, ...]) -> str:
    if not controls:
        return text
    found = rf"(\\*)({'|'.join(controls)})"
    return re.sub(found, lambda m: f"{m[1]}{m[1]}\\{m[2]}", text)


def read(rendered: str, at: int = 0) -> tuple[str, str, int] | None:
    """(role, text, place after the turn) of the turn at `at`; None if there is none."""
    header = _NAME.match(rendered, at)
    if header is None:
        return None
    at, text = header.end(), []
    for control in _CONTROL.finditer(rendered, at):
        slashes, mark = control[1], control[2]
        text += [rendered[at : control.start()], slashes[: len(slashes) // 2]]
        at = control.end()
        if len(slashes) % 2:
            text.append(mark)
            continue
        body = "".join(text)
        if mark == OPEN or not body.endswith(" ") or slashes or rendered[at : at + 1] != "\n":
            return None
        return _role(header[1]), body[:-1], at + 1
    return None


def render(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start and end of its body): the least escaped form that reads back as given."""
    head = f"### {_name(role)}: "
    controls: tuple[str, ...] = ()
    while True:
        body = escape(text, controls)
        rendered = f"{head}{body}{_TAIL}"
        if read(rendered) == (role, text, len(rendered)):
            return rendered, len(head), len(head) + len(body)
        left = [c for c in CONTROLS if c in text and c not in controls]
        if not left:
            raise Conflict(f"a turn of role {role!r} does not read back")
        controls = (*controls, left[0])


def format_turns(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, rendered, and the loss span within `rendered`.

    `loss_start` and `loss_end` are code points around the text of learned roles, else null.  Works
    row by row in the scan task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, turns, roles, texts = batch.columns
            roles = [r or "" for r in roles.to_pylist()]
            texts = [t or "" for t in texts.to_pylist()]
            made = [render(r, t) for r, t in zip(roles, texts)]
            learned = [r in LEARNED for r in roles]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    turns,
                    pa.array(roles, pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] if k else None for m, k in zip(made, learned)], pa.int32()),
                    pa.array([m[2] if k else None for m, k in zip(made, learned)], pa.int32()),
                ],
                ["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end"],
            )

    rows = df.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    schema = "conv_id long, turn long, role string, text string, rendered string, loss_start int, loss_end int"
    return rows.mapInArrow(run, schema)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss spans: whole strings, for conversations that fit into a row."""
    order = F.struct("turn", "role", "text", "rendered", "loss_start", "loss_end")
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("turns"))
    nothing = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")

    def step(so_far, one):
        at = so_far["at"]
        span = F.array(F.struct((at + one["loss_start"]).alias("start"), (at + one["loss_end"]).alias("end")))
        return F.struct(
            (at + F.length(one["rendered"])).alias("at"),
            F.when(one["loss_start"].isNull(), so_far["loss"]).otherwise(F.concat(so_far["loss"], span)).alias("loss"),
        )

    start = F.struct(F.lit(0).alias("at"), nothing.alias("loss"))
    return grouped.select(
        "conv_id",
        F.array_join(F.col("turns.rendered"), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda end: end["loss"]).alias("loss"),
    )


class _Reading:
    """What is read back from one conversation, turn by turn; holds no more than one turn."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.size, self.rest = conv, 0, 0, 0, ""
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def feed(self, role: str, text: str, rendered: str, start: int | None, end: int | None) -> None:
        self.size += len(rendered)
        self.rest += rendered
        turn = read(self.rest)
        if turn is None or turn[:2] != (role, text) or turn[2] != len(self.rest):
            raise Conflict(f"conversation {self.conv} does not read back at turn {self.turns}")
        self.rest = ""
        self.turns += 1
        self.all.update(f"{turn[0]}\n{turn[1]}\n".encode())
        if start is not None:
            body = read(f"### x: {rendered[start:end]}{_TAIL}")[1]  # what the mask covers, unescaped
            self.loss += len(body)
            self.learned.update(body.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.size


def read_back(turns: DataFrame) -> DataFrame:
    """Read every formatted conversation and compare it with its source; digests per conversation.

    Rendering and its own check ran before the shuffle.  Here the turns of a conversation pass one
    by one in order, so memory doesn't grow with its length.  A difference raises Conflict.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh = None, True
        for batch in batches:
            done = []
            for conv, *turn in zip(*(column.to_pylist() for column in batch.columns)):
                if fresh or conv != now.conv:
                    if not fresh:
                        done.append(now.row())
                    now, fresh = _Reading(conv), False
                now.feed(*turn)
            yield _rows(done)
        if not fresh:
            yield _rows([now.row()])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.select("conv_id", "role", "text", "rendered", "loss_start", "loss_end")
    return ordered.mapInArrow(run, _READ)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


OP1_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), rendered AS (
    SELECT *, '### ' || role || ': ' || regexp_replace(text, '(\\*)(###|</turn>)', '\1\1\\\2', 'g')
        || ' </turn>' || chr(10) AS rendered
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(rendered)) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id
"""


@query("op1_chat_format", OP1_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame(
        [(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string"
    )
    return read_back(format_turns(rows.unionByName(added)))
