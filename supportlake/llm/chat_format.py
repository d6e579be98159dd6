"""Chat formatting by incremental black-box rendering.

A template is only ever called: it turns a list of messages into a string. A conversation is
rendered turn by turn; where a longer prefix's output begins with the shorter one's, the rest
is the new turn's span, where it does not, the template rewrites history. Inside a span the
text is found by rendering the turn once more with a marker in its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import arrow_map

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

START, END = "<|im_start|>", "<|im_end|>"
#: Turns that are rendered together; a longer conversation is looked at through a window of so
#: many, and the whole output is then compared with the spans found.
WINDOW = 64
_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    """No `<|` is left: one more backslash stands between the two than before."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def marked_template(messages: list[Message]) -> str:
    """Each turn between its marks, control strings in roles and texts escaped."""
    return "".join(f"{START}{_role(r)}\n{escape(t)}{END}\n" for r, t in messages)


def read_back(formatted: str) -> list[Message]:
    """The messages of a text that `marked_template` made."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


@dataclass
class Rendered:
    """spans: [begin, end) of each turn in `text`; bodies: of what `text` shows of each turn's
    text, -1 where the template does not show it as one piece. rewrites: number of the first turn whose prefix
    changed what stood before, or -1."""

    text: str
    spans: list[tuple[int, int]]
    bodies: list[tuple[int, int]]
    rewrites: int


def _marker(used: str) -> str:
    mark = "\ue000"
    while mark in used:
        mark += "\ue000"
    return mark


def _steps(messages: list[Message], render: Template, window: int) -> Rendered:
    spans, bodies, rewrites, at, first = [], [], -1, 0, 0
    before, parts = render(messages[:0]), []
    base = before
    parts.append(base)
    at = len(base)
    for k, (role, text) in enumerate(messages):
        if k - first >= window:
            first = k - window // 2
            before = render(messages[first:k])
        now = render(messages[first : k + 1])
        if not now.startswith(before):
            rewrites = k if rewrites < 0 else rewrites
            same = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), len(now))
            begin = min(same, len(now))
        else:
            begin = len(before)
        span = now[begin:]
        mark = _marker(now)
        probe = render([*messages[first:k], (role, mark)])
        head, _, tail = probe[begin:].partition(mark)
        fits = (
            probe.startswith(now[:begin] + head + mark)
            and len(span) >= len(head) + len(tail)
            and span.startswith(head)
            and span.endswith(tail)
        )
        spans.append((at, at + len(span)))
        bodies.append(
            (at + len(head), at + len(span) - len(tail)) if fits else (-1, -1)
        )
        parts.append(span)
        at += len(span)
        before = now
    return Rendered("".join(parts), spans, bodies, rewrites)


def render_turns(
    messages: list[Message], render: Template = marked_template, window: int = WINDOW
) -> Rendered:
    """Spans of all turns. Beyond `window` turns, prefixes start at most `window` turns back;
    if what they give differs from the whole output, all prefixes are rendered in full. Where
    history is rewritten, what prefixes show is not what the end shows, and every turn is located
    in the whole output instead."""
    found = _steps(messages, render, window)
    whole = render(messages)
    if found.text != whole and found.rewrites < 0 and len(messages) > window:
        found = _steps(messages, render, len(messages))
    if found.text != whole or found.rewrites >= 0:
        found.spans, found.bodies = _located(messages, render, whole)
    found.text = whole
    return found


def _shared(a: str, b: str) -> int:
    """Number of leading characters in which two strings agree."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _located(
    messages: list[Message], render: Template, whole: str
) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans and bodies of all turns in `whole`, the output for all messages.

    A body is what a marker in the text's place would stand for, with all else unchanged. A
    span is what goes when the turn is left out; where repeated characters leave its place open
    it begins where the turn before ends. If leaving the turn out changes other turns too, the
    span is the body. A turn that is not shown has an empty span; (-1, -1) is one that cannot
    be told from the others, and no such turn has a body.
    """
    base = render([])
    spans, bodies, end = [], [], len(base) if whole.startswith(base) else 0
    mark = _marker(whole + "".join(r + t for r, t in messages))
    for k, (role, _) in enumerate(messages):
        probe = render([*messages[:k], (role, mark), *messages[k + 1 :]])
        head, _, tail = probe.partition(mark)
        fits = (
            probe.count(mark) == 1
            and len(whole) >= len(head) + len(tail)
            and whole.startswith(head)
            and whole.endswith(tail)
        )
        body = (len(head), len(whole) - len(tail)) if fits else (-1, -1)
        without = render([*messages[:k], *messages[k + 1 :]])
        size = len(whole) - len(without)
        last = _shared(whole, without)
        first = len(without) - _shared(whole[::-1], without[::-1])
        if fits:  # the body lies within the span
            first, last = max(first, body[1] - size), min(last, body[0])
        if size >= 0 and max(first, 0) <= last:
            begin = min(max(end, first, 0), last)
            span = (begin, begin + size)
        else:
            span = body
        spans.append(span)
        bodies.append(body)
        end = span[1] if span[0] >= 0 else end
    return spans, bodies


def conversations_of(rows: DataFrame) -> DataFrame:
    """The rows of each conversation next to each other, in order of turn."""
    return (
        rows.select(
            "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Message]]]:
    none = object()
    current, held = none, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if conv != current:
                if current is not none:
                    yield current, held
                current, held = conv, []
            held.append((role, text))
    if current is not none:
        yield current, held


def format_conversations(
    rows: DataFrame,
    render: Template = marked_template,
    learn: str = "assistant",
    window: int = WINDOW,
) -> DataFrame:
    """(conv_id, formatted, spans, loss, rewrites), a row per conversation.

    spans: [begin, end) code points of each turn; loss: of the texts of `learn` turns, for
    turns whose text the template shows as it is. rewrites: first turn that changed earlier
    output, or -1. A null role or text is empty. Turns with the same number follow by role and
    text; repeated rows are turns of their own; turns without a number come first; rows without
    conv_id make one conversation. An empty table gives no rows. Other columns are not used.

    A conversation is one task's work and must fit its memory, as one text must.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, messages in _grouped(batches):
            done = render_turns(messages, render, window)
            loss = [b for b, (role, _) in zip(done.bodies, messages) if role == learn and b[0] >= 0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv], ids), pa.array([done.text]),
                    pa.array([done.spans], pa.list_(pa.list_(pa.int64()))),
                    pa.array([loss], pa.list_(pa.list_(pa.int64()))),
                    pa.array([done.rewrites], pa.int64()),
                ],
                ["conv_id", "formatted", "spans", "loss", "rewrites"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    ids = to_arrow_type(rows.schema["conv_id"].dataType)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return arrow_map(
        conversations_of(rows).select("conv_id", "role", "text"),
        task,
        f"conv_id {kind}, formatted string, spans array<array<long>>, loss array<array<long>>, "
        "rewrites long",
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
                learned = "".join(unescape(text[a:b]) for a, b in loss)
                out.append(
                    (
                        len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(learned),
                        hashlib.sha256(learned.encode()).hexdigest(), len(text),
                    )
                )
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, k) for c, k in zip(columns, kinds)),
                    batch.column(3),
                ],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                 "formatted_chars", "rewrites"],
            )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return arrow_map(
        formatted.select("conv_id", "formatted", "loss", "rewrites"),
        task,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long, rewrites long",
    )
