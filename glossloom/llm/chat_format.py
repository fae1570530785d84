"""Chat formatting from an event log.

A log has a row for each event: conversation, turn, sequence number, kind, role
and text. Kinds are `message` (a whole message), `delta` (text to append),
`edit` (text that replaces what the turn has) and `regenerate` (drops what the
turn has; deltas that follow make it anew). A log is dealt by conversation and
turn, so the turns of one very long conversation spread over all tasks, sorted
by sequence, and folded as a stream: a task holds one message at a time.

Each message is then rendered by itself. The template writes

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

and escapes backslashes and control strings inside roles and texts: a
backslash is doubled, and a control string gets one after its first character,
so it cannot be mistaken for the template's own and is given back exactly. A
role's line feeds get a backslash before them. A conversation's output is its
parts in order. The loss mask covers the texts of assistant messages, as
character ranges of the part.

Results: null texts and roles are empty. Rows of one conversation and turn with
kind `message` are messages of their own, ordered by role and text; so equal
rows give equal messages. Nulls sort first: a null turn comes before all
others, a null conversation is one of its own, a null kind is `message`, a null
sequence number 0. Of events of one sequence number messages come first, then
regenerations, edits and deltas, each by role and text. An unknown kind is an
error. A `delta`, `edit` or
`regenerate` without a message before it in its turn begins one. An empty log
gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that mean something to one chat template or another.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
LOSS_ROLE = "assistant"
#: Kinds of events, in the order in which those of one sequence number are folded.
KINDS = ("message", "regenerate", "edit", "delta")

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_PART = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)

PARTS = "conv_id long, turn long, nth long, formatted string, loss array<struct<first: long, length: long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, list[dict]]:
    """A message in the template, and its loss mask."""
    head, body = "<|im_start|>" + escape(role).replace("\n", "\\\n") + "\n", escape(text)
    return f"{head}{body}<|im_end|>\n", [{"first": len(head), "length": len(body)}] if role == LOSS_ROLE else []


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of whole parts."""
    found, at = [], 0
    while at < len(formatted):
        m = _PART.match(formatted, at)
        if m is None:
            raise ValueError("not in the template")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def events_of(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of whole messages as a log."""
    return messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))


def _fold(batches):
    """Events sorted by conversation, turn and sequence to rendered messages, in that order."""
    now, nth, role, held = None, 0, "", None

    def done():
        formatted, loss = render(role, "".join(held))
        return now[0], now[1], nth, formatted, loss

    for batch in batches:
        out = []
        columns = (batch[c].to_pylist() for c in ("conv_id", "turn", "kind", "role", "text"))
        for conv, turn, kind, new_role, text in zip(*columns, strict=True):
            text = text or ""
            if (conv, turn) != now or held is None or kind == "message":
                if held is not None:
                    out.append(done())
                nth = nth + 1 if (conv, turn) == now else 0
                now, role, held = (conv, turn), new_role or "", [text] if kind != "regenerate" else []
                if kind not in KINDS:
                    raise ValueError(f"unknown kind of event: {kind}")
            elif kind == "delta":
                held.append(text)
            elif kind == "edit":
                held = [text]
            elif kind == "regenerate":
                held = []
            else:
                raise ValueError(f"unknown kind of event: {kind}")
        yield _parts(out)
    if held is not None:
        yield _parts([done()])


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())])))
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "nth", "formatted", "loss"])


def formatted_parts(events: DataFrame) -> DataFrame:
    """Each message rendered: conv_id, turn, nth (of its turn), formatted, loss (ranges under the loss mask). In order of turn and nth they are the conversation."""
    rows = events.select("conv_id", "turn", F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), "role", "text")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return rows.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", order, "role", "text").mapInArrow(_fold, PARTS)


def _read_back(batches):
    """Digests of conversations, from their parts in order; each part is read and let go."""
    now, state = (), None
    columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def done():
        return now[0], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], columns)

    for batch in batches:
        out = []
        for conv, formatted, loss in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), batch["loss"].to_pylist(), strict=True):
            if (conv,) != now:
                if state:
                    out.append(done())
                now, state = (conv,), {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            for role, text in parse(formatted):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["first"] : span["first"] + span["length"]])
                state["loss_chars"] += len(text)
                state["loss"].update(text.encode())
            state["chars"] += len(formatted)
        yield batch_of(out)
    if state:
        yield batch_of([done()])


def digest(parts: DataFrame) -> DataFrame:
    """The contract's columns, read back from the rendered parts. A hash over a conversation takes its parts one after the other, so here a conversation is one task's; it streams through."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "nth").mapInArrow(_read_back, schema)
