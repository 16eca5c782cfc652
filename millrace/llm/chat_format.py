"""Operator 8, chat formatting by a finite-state machine and a declarative template.

A Template says how a turn is opened and closed, which roles may follow which, and for
which roles loss is taken.  Conversations stream through the machine in the order of their
turns (then role and text; null turns first): it emits three text segments a turn - opening,
text and closing - each with a loss flag, and notes turns that the order doesn't allow.
Such turns are formatted all the same.

Inside roles and texts the escape character is doubled and control strings get it in front,
so that no text can open or close a turn and unescaping gives it back.

Rows are dealt by conversation and sorted, and stream through with nothing held but the
current turn, so that a conversation may have any number of turns.  Null texts and roles
are empty.  Rows that repeat (conv_id, turn) are turns of their own, in the order above; rows without conv_id are one conversation.
A very long text is one segment, however long.  An empty table gives no segments.  Columns other than conv_id, turn, role and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, turn long, part int, segment string, loss boolean, allowed boolean"
PARTS = ("opening", "text", "closing")


@dataclass(frozen=True)
class Template:
    """opening: with the role's name in place of {role}.  follows: the roles that may come after a state;
    a state is the last turn's role, at first "".  loss: roles whose texts are learnt.  last: roles that may end a conversation."""

    opening: str = "### {role}: "
    closing: str = "</turn>\n"
    escape: str = "\\"
    names: dict = field(default_factory=lambda: {"user": "User", "assistant": "Assistant", "system": "System"})
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    loss: tuple = ("assistant",)
    last: tuple = ("assistant",)

    @property
    def heads(self) -> tuple[str, str]:
        before, after = self.opening.split("{role}")
        return before, after

    @property
    def controls(self) -> list[str]:
        """Strings that get an escape in front: the openings' start, the role's end and the closing, trimmed."""
        before, after = self.heads
        return sorted({self.closing.strip(), before.strip(), after.strip()} - {""}, key=len, reverse=True)

    def escaped(self, text: str) -> str:
        one = "|".join(re.escape(x) for x in [self.escape, *self.controls])
        return re.sub(one, lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(" + "|".join(re.escape(x) for x in [self.escape, *self.controls]) + ")", r"\1", text)

    def open(self, role: str) -> str:
        before, after = self.heads
        return before + self.escaped(self.names.get(role, role)) + after

    def reader(self) -> re.Pattern:
        """Matches one formatted turn; groups: role's name and text, both escaped."""
        before, after = (re.escape(x) for x in self.heads)
        escape, controls = re.escape(self.escape), "|".join(re.escape(x) for x in self.controls)
        inner = f"((?:{escape}(?:{escape}|{controls})|(?!{escape}|{controls}).)*+)"
        return re.compile(before + inner + after + inner + re.escape(self.closing), re.S)


def ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def chat_segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn, part (0 opening, 1 text, 2 closing), segment, loss, allowed; within a partition in order, conversation by conversation."""
    t = template or Template()

    def each(batches):
        conv, state = None, None
        for batch in batches:
            out = []
            for c, turn, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if state is None or c != conv:
                    conv, state = c, ""
                allowed = role in t.follows.get(state, ())
                state = role
                for part, segment in enumerate((t.open(role), t.escaped(text), t.closing)):
                    out.append((c, turn, part, segment, part == 1 and role in t.loss, allowed))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds)], ["conv_id", "turn", "part", "segment", "loss", "allowed"])

    return ordered(conversations).mapInArrow(each, SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Parses the formatted conversations (segments, ordered within partitions) again: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, valid (all turns allowed, and the last may end it)."""
    t = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def each(batches):
        turn, role_of = t.reader(), {v: k for k, v in t.names.items()}
        conv, open_, out = None, None, []

        def close(s):
            if s["text"]:
                raise ValueError(f"conversation {conv} doesn't end with a turn's end")
            out.append((conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["allowed"] and s["role"] in t.last))

        def taken():
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds)], names)
            out.clear()
            return batch

        for batch in batches:
            for c, segment, loss, allowed in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if open_ is None or c != conv:
                    if open_ is not None:
                        close(open_)
                    conv, open_ = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "text": "", "allowed": True, "role": ""}
                s = open_
                s["allowed"] &= allowed
                s["chars"] += len(segment)
                s["text"] += segment
                if loss:
                    plain = t.unescaped(segment)
                    s["loss_chars"] += len(plain)
                    s["loss"].update(plain.encode())
                while s["text"].endswith(t.closing) and (m := turn.match(s["text"])):
                    name = t.unescaped(m[1])
                    s["role"] = role_of.get(name, name)
                    s["turns"].update(f"{s['role']}\n{t.unescaped(m[2])}\n".encode())
                    s["n"] += 1
                    s["text"] = s["text"][m.end() :]
            yield taken()
        if open_ is not None:
            close(open_)
            yield taken()

    return segments.mapInArrow(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op8_chat_format(spark, sf_dir) -> DataFrame:
    from .common import read

    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return read_back(chat_segments(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)))


#: What SQL can say: all but the number of formatted characters comes from the rows themselves, and that follows from the template.
OP8_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(t)),
sized AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k,
         length(replace(replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '###', '\###'), ':', '\:')) AS n FROM rows_
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + n + 6 + 8)::BIGINT AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'user' THEN role = 'assistant' ELSE role = 'user' END)
         AND arg_max(role, k) = 'assistant' AS valid
FROM sized GROUP BY conv_id
"""
