"""Chat formatting by a finite-state machine over roles and a declarative template.

The template gives for each role the strings before and after its text, whether its text is learnt
(the loss flag), and from which states the role may follow. One pass over rows sorted by conversation
and turn emits one row per segment; state is the current role's alone, so a conversation of any
length streams through a task. Segments of marks never carry loss.

Texts are escaped reversibly: the escape character is doubled, and each control string of the
template is split after its first character by escape + '-'. Reading back scans for unescaped marks.

Defined cases. Null text is empty; a null role is the empty role. Roles that the template doesn't
know are marked with their name, carry no loss and make the conversation invalid; it's formatted all the
same. Rows of a conversation go by turn, then role, then text; null turns first. Rows with a null
conv_id are one conversation. Repeated rows are repeated turns. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool
    follows: frozenset[str]


@dataclass(frozen=True)
class Template:
    """turns by role; START is the state before the first turn. A conversation may end after `ends`."""

    turns: dict[str, Turn]
    ends: frozenset[str]
    other_before: str
    other_name_end: str
    other_after: str
    controls: tuple[str, ...]


START = "<start>"
INST = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n", False, frozenset({START})),
        "user": Turn("<s>[INST] ", " [/INST]", False, frozenset({START, "system", "assistant"})),
        "assistant": Turn("[OUT] ", " </s>\n", True, frozenset({"user"})),
    },
    ends=frozenset({"user", "assistant"}),
    other_before="[ROLE] ",
    other_name_end=" [/ROLE]",
    other_after=" [/END]\n",
    controls=("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[/END]"),
)


def escape(text: str, template: Template = INST) -> str:
    found = "|".join(map(re.escape, sorted(template.controls, key=len, reverse=True)))
    doubled = text.replace(ESCAPE, ESCAPE * 2)
    return re.sub(found, lambda m: f"{m[0][0]}{ESCAPE}-{m[0][1:]}", doubled)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|-)", lambda m: ESCAPE if m[1] == ESCAPE else "", text)


def segments_of(role: str, text: str, template: Template = INST) -> list[tuple[str, bool]]:
    """(text, loss) of the parts of one turn."""
    turn = template.turns.get(role)
    if turn:
        return [(turn.before, False), (escape(text, template), turn.loss), (turn.after, False)]
    return [(template.other_before + escape(role, template) + template.other_name_end, False), (escape(text, template), False), (template.other_after, False)]


class Machine:
    """Roles in, validity out."""

    def __init__(self, template: Template = INST) -> None:
        self.template, self.state, self.valid = template, START, True

    def step(self, role: str) -> bool:
        turn = self.template.turns.get(role)
        ok = turn is not None and self.state in turn.follows
        self.valid &= ok
        self.state = role
        return ok

    def end(self) -> bool:
        return self.valid and self.state in self.template.ends


class Reader:
    """Reads turns back from the segments of one conversation: a mark opens a turn, its end closes it."""

    def __init__(self, template: Template = INST) -> None:
        self.template = template
        self.role: str | None = None
        self.text: list[str] = []

    def feed(self, segment: str) -> tuple[str, str] | None:
        """(role, text) when the segment closes a turn."""
        t = self.template
        if self.role is None:
            for role, turn in t.turns.items():
                if segment == turn.before:
                    self.role = role
                    return None
            if segment.startswith(t.other_before) and segment.endswith(t.other_name_end):
                self.role = unescape(segment[len(t.other_before) : -len(t.other_name_end)])
                return None
            raise ValueError(f"no mark: {segment[:40]!r}")
        known = t.turns.get(self.role)
        if segment == (known.after if known else t.other_after) and self.text:
            out = self.role, unescape("".join(self.text))
            self.role, self.text = None, []
            return out
        self.text.append(segment)
        return None


def parse(formatted: str, template: Template = INST) -> list[tuple[str, str]]:
    """Turns of a whole formatted string, for which segment borders aren't known."""
    out, at = [], 0
    while at < len(formatted):
        for role, turn in template.turns.items():
            if formatted.startswith(turn.before, at):
                at, after = at + len(turn.before), turn.after
                break
        else:
            at += len(template.other_before)
            end = formatted.index(template.other_name_end, at)
            role, at, after = unescape(formatted[at:end]), end + len(template.other_name_end), template.other_after
        end = formatted.index(after, at)
        out.append((role, unescape(formatted[at:end])))
        at = end + len(after)
    return out


SEGMENTS = "conv_id long, turn long, part int, segment string, loss boolean, turn_ok boolean"


def format_conversations(df: DataFrame, template: Template = INST) -> DataFrame:
    """df (conv_id, turn, role, text) -> SEGMENTS, in order inside each conversation and partition.

    Conversations are dealt by id and sorted on disk; no task holds one in memory.
    """
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, current, begun = Machine(template), None, False
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != current:
                    machine, current, begun = Machine(template), conv, True
                ok = machine.step(role)
                for i, (segment, loss) in enumerate(segments_of(role, text, template)):
                    out.append((conv, turn, i, segment, loss, ok))
                    size += len(segment)
                if size > 4 << 20:
                    yield _batch(out, ["conv_id", "turn", "part", "segment", "loss", "turn_ok"], _SEGMENT_TYPES)
                    out, size = [], 0
            yield _batch(out, ["conv_id", "turn", "part", "segment", "loss", "turn_ok"], _SEGMENT_TYPES)

    return rows.mapInArrow(emit, SEGMENTS)


_SEGMENT_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def digests(segments: DataFrame, template: Template = INST) -> DataFrame:
    """Read segments back: one row per conversation, all from the formatted output alone.

    segments must be the output of format_conversations, still dealt and sorted as it was.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def close():
            conv, turns, turns_sha, chars, loss_sha, size, machine, _ = state
            return conv, turns, turns_sha.hexdigest(), chars, loss_sha.hexdigest(), size, machine.end()

        for batch in batches:
            out = []
            for conv, _, _, segment, loss, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(close())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, Machine(template), Reader(template)]
                state[5] += len(segment)
                if loss:
                    learnt = unescape(segment)
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                turn = state[7].feed(segment)
                if turn:
                    state[1] += 1
                    state[2].update(f"{turn[0]}\n{turn[1]}\n".encode())
                    state[6].step(turn[0])
            yield _batch(out, _DIGESTS, _DIGEST_TYPES)
        if state is not None:
            yield _batch([close()], _DIGESTS, _DIGEST_TYPES)

    return segments.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def report(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)))


#: What the texts alone must give; the formatted length and validity come from the template.
SQL_CHECKED = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     e AS (SELECT *, len(text) + len(text) - len(replace(text, chr(92), ''))
                  + 2 * (len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|<s>|</s>|\\[INST\\]|\\[/INST\\]|\\[OUT\\]|\\[ROLE\\]|\\[/ROLE\\]|\\[/END\\]')))
                  + CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 10 + 8 WHEN 'assistant' THEN 6 + 6
                              ELSE 7 + len(role) + 8 + 8 END AS size,
                  coalesce(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                                     WHEN 'assistant' THEN before = 'user' END, false) AS ok
           FROM (SELECT *, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars,
       bool_and(ok) AND last(role ORDER BY turn, role, text) IN ('user', 'assistant') AS valid
FROM e GROUP BY conv_id
"""
