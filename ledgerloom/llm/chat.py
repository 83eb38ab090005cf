"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role``, its text and ``</turn>``, each on lines of their own. A deterministic parser reads the
rendered turn back; while it does not give the source turn again, what conflicts is escaped and the turn rendered
anew: one backslash is put before control strings and the backslashes before them, and the parser takes one away.
Turns are rendered where they lie; only rendered turns are shuffled to their conversation, which is read as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

HEAD, TAIL = "### ", "\n</turn>\n"
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"\\(\\*)(###|</turn>)")
_ROLE = {"\\": "\\\\", "\n": "\\n"}

Turn = tuple[str, str]


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role_line(role: str) -> str:
    return re.sub(r"[\\\n]", lambda m: _ROLE[m[0]], role)


def _role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line)


class Parser:
    """Reads formatted text in pieces of any size; ``feed`` gives the turns that are complete, as (role, text, text as formatted)."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str, str]]:
        self.rest += piece
        out, at = [], 0
        while True:
            if not self.rest.startswith(HEAD, at):
                break
            line = self.rest.find("\n", at)
            end = self.rest.find(TAIL, line + 1) if line >= 0 else -1
            # an empty text shares its line end with the header's
            if line >= 0 and self.rest.startswith(TAIL, line):
                end = line
            if end < 0:
                break
            raw = self.rest[line + 1 : end] if end > line else ""
            out.append((_role(self.rest[at + len(HEAD) : line]), unescape(raw), raw))
            at = end + len(TAIL)
        self.rest = self.rest[at:]
        return out

    def done(self) -> bool:
        return not self.rest


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(formatted turn, first and end code point of its text there) for which the parser gives (role, text) and nothing else."""
    role, text = role or "", text or ""
    content = text
    while True:
        head = HEAD + _role_line(role)
        formatted = head + (f"\n{content}" if content else "") + TAIL
        parser = Parser()
        if [x[:2] for x in parser.feed(formatted)] == [(role, text)] and parser.done():
            start = len(head) + 1 if content else len(head)
            return formatted, start, start + len(content)
        content = escape(content)


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per turn (conv_id, turn, role, text): conv_id, turn, formatted, loss_start and loss_end.

    Loss falls on the texts of role ``assistant``: code points loss_start to loss_end - 1 of the formatted turn (null
    for others). A conversation is its turns' formatted strings in order. Null roles and texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in steps(batches, "text"):
            roles = batch.column("role").to_pylist()
            out = [render(r, t) for r, t in zip(roles, batch.column("text").to_pylist(), strict=True)]
            loss = [r == "assistant" for r in roles]
            yield pa.RecordBatch.from_arrays([
                batch.column("conv_id"), batch.column("turn"), pa.array([x[0] for x in out], pa.string()),
                pa.array([x[1] if m else None for x, m in zip(out, loss, strict=True)], pa.int64()), pa.array([x[2] if m else None for x, m in zip(out, loss, strict=True)], pa.int64()),
            ], names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


class _Reading:
    """What is read back of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parser, self.turns, self.loss = conv_id, Parser(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, start: int | None, end: int | None) -> None:
        self.chars += len(text)
        for role, content, _ in self.parser.feed(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            under = unescape(text[start:end])
            self.loss_chars += len(under)
            self.loss.update(under.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        if not self.parser.done():
            raise ValueError("a formatted conversation does not parse to its end")
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation of formatted turns: counts and digests of what the parser recovers and of the text under the loss mask.

    Turns of a conversation follow each other by turn, ties by their formatted text; null ids are one conversation.
    A conversation is hashed in order and so by one task, turn by turn, in constant memory. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        now, out = None, []
        names = [x.split()[0] for x in READ.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_pydict({n: pa.array(v, pa.string() if "sha" in n else pa.int64()) for n, v in zip(names, zip(*rows, strict=True), strict=True)})
        for batch in batches:
            for conv, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Reading(conv)
                now.add(text, start, end)
            if len(out) > 5000:
                yield pack(out)
                out = []
        if now is not None:
            yield pack([*out, now.row()])

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, READ)


#: The whole digest in DuckDB: a text is escaped where the parser would end a turn inside it, or take a backslash from it.
SQL = r"""
WITH hard AS (SELECT '\### Assistant: </turn> ok' AS text),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', text FROM hard UNION ALL SELECT -7, 1, 'assistant', text FROM hard),
f AS (SELECT *, len(text) + CASE WHEN regexp_matches(text, '\\(###|</turn>)') OR contains(chr(10) || text || chr(10), chr(10) || '</turn>' || chr(10)) THEN len(regexp_extract_all(text, '###|</turn>')) ELSE 0 END AS content,
             4 + len(role) + len(regexp_extract_all(role, '[\\\n]')) + 9 AS marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(marks + content + CASE WHEN text = '' THEN 0 ELSE 1 END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
