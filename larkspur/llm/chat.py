"""Operator 4, chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns, in order of their number, go through the machine, which says whether
the order of roles is valid; the template gives each turn's head and tail and says which roles
bear loss. The output is one formatted string and its segments, each with a loss flag. Control
strings inside a text are escaped by a backslash before them, and backslashes are doubled, so
``read_back`` gives the turns exactly.

Defined results: a null or empty text is an empty turn; a null role is the empty role, and a
role that the machine doesn't know makes the order invalid but is formatted all the same; ties
in the turn number are ordered by role, then text; repeated rows are repeated turns; a null
conv_id is a conversation of its own; an empty table gives an empty one; other columns of the
input don't matter. A conversation's formatted string is one value, so its turns meet in one
task; conversations are dealt by id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks as B


@dataclass(frozen=True)
class Template:
    """How turns are marked. ``{role}`` in the head is the escaped role."""

    head: str = "### {role}: "
    tail: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state to role to next state
    machine: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        """What must not occur unescaped in a text or role."""
        parts = [*re.split(r"\{role\}", self.head), self.tail]
        return sorted({x.strip() for x in parts if x.strip()} | {"\n"}, key=lambda x: (-len(x), x))


class Formatter:
    def __init__(self, template: Template) -> None:
        self.t = template
        self.special = re.compile("|".join(re.escape(x) for x in ["\\", *template.controls]))
        before, after = template.head.split("{role}")
        self.before, self.marks = before, [re.compile(r"\\.|" + re.escape(x), re.DOTALL) for x in (after, template.tail)]

    def escape(self, text: str) -> str:
        return self.special.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def valid(self, roles: list[str]) -> bool:
        state = "start"
        for role in roles:
            state = self.t.machine.get(state, {}).get(role)
            if state is None:
                return False
        return state in self.t.final

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
        """The string, and (start, end, loss) of its segments, which cover it without gaps."""
        out, segments, at = [], [], 0
        for role, text in turns:
            for part, loss in ((self.t.head.replace("{role}", self.escape(role)), False), (self.escape(text), role in self.t.loss_roles), (self.t.tail, False)):
                if part or loss:
                    out.append(part)
                    segments.append((at, at + len(part), loss))
                    at += len(part)
        return "".join(out), segments

    def read_back(self, formatted: str) -> list[tuple[str, str]]:
        turns, at = [], 0
        while at < len(formatted):
            if not formatted.startswith(self.before, at):
                raise ValueError(f"no turn at {at}")
            at += len(self.before)
            parts = []
            for mark in self.marks:
                m = next((m for m in mark.finditer(formatted, at) if m[0][0] != "\\"), None)
                if m is None:
                    raise ValueError(f"no end of the turn's part at {at}")
                parts.append(self.unescape(formatted[at : m.start()]))
                at = m.end()
            turns.append((parts[0], parts[1]))
        return turns


SEGMENTS = "array<struct<start: int, end: int, loss: boolean>>"
KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("loss", pa.bool_())]))


def chat_format(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, valid, formatted and segments of each conversation (rows by conv_id, turn, role, text)."""
    template = template or Template()
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(template)
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            valid, formatted, segments = [], [], []
            for turns in b.column(1).to_pylist():
                pairs = [(x["role"], x["text"]) for x in turns]
                s, parts = f.format(pairs)
                valid.append(f.valid([r for r, _ in pairs]))
                formatted.append(s)
                segments.append([{"start": x, "end": y, "loss": z} for x, y, z in parts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(valid), pa.array(formatted, pa.string()), pa.array(segments, KIND)], names=["conv_id", "valid", "formatted", "segments"])

    return whole.mapInArrow(B.streaming(work), f"conv_id {kind}, valid boolean, formatted string, segments {SEGMENTS}")


def chat_read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """formatted with turns, parsed from the string, and loss_text: all text under the loss mask, unescaped."""
    template = template or Template()
    names = formatted.columns
    schema = T.StructType([*formatted.schema.fields, *T.StructType.fromDDL("turns array<struct<role: string, text: string>>, loss_text string").fields])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(template)
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            texts = b.column(names.index("formatted")).to_pylist()
            masks = b.column(names.index("segments")).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in f.read_back(x)] for x in texts]
            loss = ["".join(f.unescape(x[s["start"] : s["end"]]) for s in m if s["loss"]) for x, m in zip(texts, masks, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(turns, kind), pa.array(loss, pa.string())], names=[*names, "turns", "loss_text"])

    return formatted.mapInArrow(B.streaming(work), schema)


#: A conversation whose texts hold the template's own control strings.
OWN_MARKS = r"\### Assistant: </turn> ok"


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", OWN_MARKS), (-7, 1, "assistant", OWN_MARKS)], rows.schema)
    out = chat_read_back(chat_format(rows.unionByName(own)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


CHAT_SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\\', '\\\\'), '</turn>', '\\</turn>'), '###', '\\###'), ':', '\\:'), chr(10), '\\' || chr(10)) AS esc,
    replace(replace(replace(replace(replace(role, '\\', '\\\\'), '</turn>', '\\</turn>'), '###', '\\###'), ':', '\\:'), chr(10), '\\' || chr(10)) AS esc_role,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS prev
  FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  sum(length(esc) + length(esc_role) + 15)::BIGINT AS formatted_chars,
  bool_and((prev || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AND bool_or(k = n AND role = 'assistant') AS valid
FROM e GROUP BY conv_id
"""
