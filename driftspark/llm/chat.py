"""Conversations to training text whose grammar survives any content.

A conversation is rendered with turn marks, parsed back by a deterministic parser and compared with its source. Turns that
come back changed are escaped and the text is rendered again, until all come back identical. A mark inside a text gets one
underscore after ``<|`` (``<|im_end|>`` to ``<|_im_end|>``, which itself becomes ``<|__im_end|>``); the parser takes one away.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import pieces

START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<\|(_*)(im_start|im_end)\|>")
_ROLE_MARK = re.compile(r"<\|(_*)(im_start|im_end|nl)\|>")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _MARK.sub(r"<|_\1\2|>", text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: f"<|{m[1][1:]}{m[2]}|>", text)


def escape_role(role: str) -> str:
    return _ROLE_MARK.sub(r"<|_\1\2|>", role).replace("\n", "<|nl|>")


def unescape_role(role: str) -> str:
    return _ROLE_MARK.sub(lambda m: f"<|{m[1][1:]}{m[2]}|>" if m[1] else "\n" if m[2] == "nl" else m[0], role)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{START}{role}\n{text}{END}\n" for role, text in turns)


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the text's span) of each turn; None if the whole isn't turns, or one holds a mark."""
    out, at = [], 0
    while at < len(text):
        if not (m := _TURN.match(text, at)):
            return None
        if any(mark in x for mark in (START, END) for x in m.groups()):
            return None
        out.append((unescape_role(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return out


def format_conversation(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The rendered text and its turns as read back, which equal the source."""
    escaped = [False] * len(turns)
    while True:
        text = render([(escape_role(r), escape(t)) if e else (r, t) for (r, t), e in zip(turns, escaped)])
        back = parse(text)
        if back is not None and [b[:2] for b in back] == turns:
            return text, back
        if all(escaped):
            raise ValueError("a conversation does not survive its grammar")
        alone = [parse(render([x])) for x in turns]
        more = [e or a is None or [b[:2] for b in a] != [x] for e, a, x in zip(escaped, alone, turns)]
        escaped = more if more != escaped else [True] * len(turns)


def format_chats(conversations: DataFrame, train_on: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text, …) to one row per conversation: conv_id, formatted, loss_spans array of (start, end) in code
    points, turns (role, text as read back).

    Turns are ordered by turn, null first, then role and text. Null role or text: empty. Rows repeated stay repeated. A null
    conv_id is one conversation. Other columns are ignored; an empty table gives no rows. A conversation is one output
    string, so its turns are gathered in one row; texts may be of any length as long as a conversation fits in a task.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches):
        for b in pieces(batches, 64):
            formatted, spans, turns = [], [], []
            for row in b.column(1).to_pylist():
                text, back = format_conversation([(t["role"], t["text"]) for t in row])
                formatted.append(text)
                spans.append([{"start": s, "end": e} for role, _, s, e in back if role == train_on])
                turns.append([{"role": r, "text": t} for r, t, _, _ in back])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            pair = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.record_batch([b.column(0), pa.array(formatted, pa.string()), pa.array(spans, span), pa.array(turns, pair)], names=["conv_id", "formatted", "loss_spans", "turns"])

    return whole.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, turns array<struct<role:string,text:string>>")


def digests(chats: DataFrame) -> DataFrame:
    """What a formatted conversation holds, read back from the text and its spans alone."""

    def run(batches):
        for b in pieces(batches, 64):
            out = []
            for conv, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                turns = parse(text)
                loss = [unescape(text[s["start"] : s["end"]]) for s in spans]
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _, _ in turns)), sum(map(len, loss)), sha("".join(loss)), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*out)) or [()] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The same digests in DuckDB: a turn is escaped if it has a mark with any number of underscores.
SQL = r"""
with conv as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(12 + length(role) + 1 + length(regexp_replace(text, '<\|(_*)(im_start|im_end)\|>', '<|_\1\2|>', 'g')) + 11)::bigint as formatted_chars
from conv group by conv_id
"""
