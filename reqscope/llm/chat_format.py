"""Operator 5: chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  The successive
prefixes of a conversation are rendered and consecutive outputs compared: what a prefix adds
is the turn's span; if it does not start with the output before, the template has rewritten
history, and the turn is flagged with the place from which the output changed.  Within a span,
the template is asked again with two probe texts for the last turn: what both outputs have in
common is the turn's header and footer, the rest is its text.  So nothing about the template
is assumed, and the loss mask (the texts of assistant turns) follows from its output.

Turns stream through a task in order and pieces leave it in blocks of ``block`` turns.  Every
turn is rendered after all turns before it: a task holds the turns of one conversation and one
output, and the cost of rendering all prefixes grows with the square of the conversation.  A
template that declares ``context_free = True`` (what a turn adds depends on no other turn) is
rendered after the ``context`` turns before the block only; memory is then bounded by a block and
the cost by turns x block.

The template ``ChatMarkup`` marks turns with <|im_start|> and <|im_end|> and escapes ``<|`` in
texts and roles (and line breaks and backslashes in roles) reversibly.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), then
role and text; repeated rows are turns of their own; rows without conv_id are one conversation.
A conversation whose template rewrites history has no loss text for flagged turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_parts

Render = Callable[[list], str]
TURNS = ("conv_id long, seq long, piece string, start long, text_start long, text_end long, "
         "in_loss boolean, changed_from long")
#: Probe texts: different at both ends, without control strings.
PROBES = ("A1A", "B2B")


class ChatMarkup:
    """<|im_start|>role, line break, text, <|im_end|>, line break."""

    context_free = True
    OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

    @staticmethod
    def escape(text: str) -> str:
        """A backslash more between < and |, so that no control string is left."""
        return re.sub(r"<(\\*)\|", r"<\1\\|", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"<(\\*)\\\|", r"<\1|", text)

    @classmethod
    def role_out(cls, role: str) -> str:
        return cls.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    @classmethod
    def role_in(cls, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], cls.unescape(text))

    def __call__(self, turns: list) -> str:
        return "".join(f"{self.OPEN}{self.role_out(r)}\n{self.escape(t)}{self.CLOSE}\n" for r, t in turns)

    def read_header(self, header: str) -> str:
        return self.role_in(header.removeprefix(self.OPEN).removesuffix("\n"))


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def locate(render: Render, turns: list, before: list = ()) -> list[dict]:
    """Spans of ``turns`` in the output, rendered after the turns ``before``; offsets count from
    the end of the output of ``before``."""
    shown = list(before)
    last = render(shown) if shown else ""
    base, out = len(last), []
    for role, text in turns:
        shown.append((role, text))
        now = render(shown)
        kept = len(last) if now.startswith(last) else _common(last, now)
        one, two = (render([*shown[:-1], (role, p)]) for p in PROBES)
        head = _common(one, two)
        foot = _common(one[::-1], two[::-1])
        out.append({"piece": now[kept:], "start": kept - base, "text_start": head - base, "text_end": len(now) - foot - base,
                    "changed_from": None if kept == len(last) else kept - base})
        last = now
    return out


def _format(render: Render, loss_role: str, block: int, context: int):
    whole = not getattr(render, "context_free", False)

    def flush(conv, seq: int, offset: int, turns: list, before: list) -> tuple[list[dict], int]:
        rows = []
        end = 0
        for k, x in enumerate(locate(render, turns, before)):
            end = x["start"] + len(x["piece"])
            rows.append(x | {"conv_id": conv, "seq": seq + k, "in_loss": turns[k][0] == loss_role and x["changed_from"] is None})
        for x in rows:
            for c in ("start", "text_start", "text_end", "changed_from"):
                x[c] = None if x[c] is None else x[c] + offset
        return rows, offset + end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("piece", pa.string()), ("start", pa.int64()), ("text_start", pa.int64()),
                            ("text_end", pa.int64()), ("in_loss", pa.bool_()), ("changed_from", pa.int64())])
        conv, seq, offset, turns, before, open_ = None, 0, 0, [], [], False
        rows: list[dict] = []
        for b in batches:
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if not open_ or c != conv or len(turns) >= block:
                    if turns:
                        done, offset = flush(conv, seq, offset, turns, before)
                        rows += done
                    if open_ and c == conv:
                        seq, before, turns = seq + len(turns), before + turns if whole else turns[-context:] if context else [], []
                    else:
                        conv, seq, offset, turns, before, open_ = c, 0, 0, [], [], True
                turns.append((role or "", text or ""))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if turns:
            rows += flush(conv, seq, offset, turns, before)[0]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def format_conversations(convs: DataFrame, render: Render | None = None, loss_role: str = "assistant", block: int = 256, context: int = 1) -> DataFrame:
    """One row per turn, in order within its partition: the piece of output that the turn added
    and where it starts, where its text lies, whether the loss covers it, and the place from
    which history was rewritten (null: not)."""
    columns = [convs[f"`{c}`"].cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    ordered = convs.select(*columns).repartition(default_parts(convs.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(render or ChatMarkup(), loss_role, block, context), TURNS)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    markup = ChatMarkup()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    rows: list[dict] = []
    now: dict | None = None

    def close() -> None:
        if now:
            rows.append(now | {"turns_sha256": now["turns_sha256"].hexdigest(), "loss_sha256": now["loss_sha256"].hexdigest()})

    for b in batches:
        for x in b.to_pylist():
            if now is None or now["conv_id"] != x["conv_id"]:
                close()
                now = {"conv_id": x["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
            piece, at = x["piece"], x["start"]
            role = markup.read_header(piece[:x["text_start"] - at])
            text = markup.unescape(piece[x["text_start"] - at:x["text_end"] - at])
            now["n_turns"] += 1
            now["turns_sha256"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if x["in_loss"]:
                now["loss_chars"] += len(text)
                now["loss_sha256"].update(text.encode("utf-8", "surrogatepass"))
            now["formatted_chars"] = at + len(piece)
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its output says, read from the pieces alone (ChatMarkup's form)."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
