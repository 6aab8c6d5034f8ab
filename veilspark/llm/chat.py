"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. To learn which characters a turn produced, successive prefixes of the
turns are rendered and consecutive outputs compared: what an output adds behind the one before is that turn's span.
A template whose next output doesn't extend the last one rewrites history; this is detected, and spans are refused.

Any template is rendered for every prefix from turn 1 on, so a rewrite at whatever distance is detected; a conversation's
turns are held at once, and its time grows with the square of their number.

A template that is declared append-only (``append_only = True`` on the function) is rendered in windows of WINDOW turns;
it gets the number of turns before the window, so a window's first output extends the text so far. Memory and time
follow the window, not the conversation: rows arrive sorted and are handled as a stream, also where one conversation
has most of them. Across each edge the window with the next turn must be the window's text and that turn's span; what
a template does to still earlier windows is taken from the declaration. ``inst_template`` is declared: each turn's text
depends on that turn and on whether it is the first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bound_batches, partitions

#: Turns of a window.
WINDOW = 64

Turn = tuple[str, str]
Template = Callable[[list[Turn], int], str]


class RewritesHistory(ValueError):
    """A template's output for more turns doesn't begin with its output for fewer."""


_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:INST|ROLE)\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Control strings can't occur in the result; ``unescape`` gives the text back."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def inst_template(turns: list[Turn], before: int = 0) -> str:
    out = []
    for i, (role, text) in enumerate(turns):
        if role == "user":
            out.append(f"<s>[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)} </s>")
        else:
            out.append(("" if i + before else "<s>") + f"[ROLE]{escape(role)}[/ROLE]{escape(text)}\n")
    return "".join(out)


inst_template.append_only = True


def read_span(span: str) -> tuple[str, str, int, int]:
    """(role, text, start, end) of one turn's span of the template above; start and end are the text's, escaped."""
    if span.startswith("<s>[INST] "):
        start, end = len("<s>[INST] "), len(span) - len(" [/INST]")
        return "user", unescape(span[start:end]), start, end
    if span.startswith(" ") and span.endswith(" </s>"):
        return "assistant", unescape(span[1:-5]), 1, len(span) - 5
    head = span.index("[ROLE]") + len("[ROLE]")
    close = next(m.start() for m in re.finditer(r"\\.|\[/ROLE\]", span[head:], re.DOTALL) if m.group()[0] == "[") + head
    start, end = close + len("[/ROLE]"), len(span) - 1
    return unescape(span[head:close]), unescape(span[start:end]), start, end


def spans(template: Template, turns: list[Turn], before: int = 0) -> list[tuple[int, int]]:
    """Where each turn's characters are in ``template(turns, before)``, learnt from the outputs for all prefixes."""
    out, last = [], ""
    for k in range(1, len(turns) + 1):
        text = template(turns[:k], before)
        if not text.startswith(last):
            same = next((i for i, (x, y) in enumerate(zip(text, last, strict=False)) if x != y), min(len(text), len(last)))
            raise RewritesHistory(f"turn {before + k} changes what was rendered before, from character {same} on")
        out.append((len(last), len(text)))
        last = text
    return out


def _join(template: Template, window: tuple[int, list[Turn], str], turn: Turn, span: str) -> None:
    """The window (turns before, turns, text) with one more turn is its text and the span that this turn has by itself."""
    before, turns, text = window
    if template([*turns, turn], before) != text + span:
        raise RewritesHistory(f"turn {before + len(turns) + 1} changes what was rendered before, or its text depends on earlier turns: the template is not append-only")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _windows(batches: Iterator[pa.RecordBatch], size: int | None) -> Iterator[tuple[int | None, int, list[Turn]]]:
    """(conv_id, turns before, turns) of sorted rows; without a size, whole conversations."""
    now, before, held, any_row = None, 0, [], False
    for conv, role, text in _rows(batches):
        if any_row and conv != now or len(held) == size:
            yield now, before, held
            before = 0 if conv != now else before + len(held)
            held = []
        now, any_row = conv, True
        held.append((role or "", text or ""))
    if any_row:
        yield now, before, held


def format_conversations(conversations: DataFrame, template: Template = inst_template) -> DataFrame:
    """(conv_id, piece, before, formatted, starts, ends): a conversation's formatted text in consecutive pieces of up
    to WINDOW turns, with the spans of the turns within the piece. Turns are ordered by turn (nulls first), then role
    and text; a null role or text is empty; rows of a null conv_id are one conversation. Rows of a conversation are in
    one partition, its pieces in order. A template that rewrites history raises RewritesHistory in the task.
    """
    size_of_window = WINDOW if getattr(template, "append_only", False) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def table() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            out = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "piece", "before", "formatted", "starts", "ends"])
            rows.clear()
            return out

        size, last = 0, (0, [], "")
        for conv, before, turns in _windows(batches, size_of_window):
            at = spans(template, turns, before)
            text = template(turns, before)
            if before:
                _join(template, last, turns[0], text[: at[0][1]])
            last = before, turns, text
            for i in range(0, len(turns), WINDOW):
                piece = at[i : i + WINDOW]
                start, end = piece[0][0], piece[-1][1]
                rows.append((conv, (before + i) // WINDOW, before + i, text[start:end], [s - start for s, _ in piece], [e - start for _, e in piece]))
            size += len(text)
            if len(rows) >= 1000 or size > 4 << 20:
                yield table()
                size = 0
        if rows:
            yield table()

    rows = bound_batches(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)
    return dealt.mapInArrow(run, "conv_id long, piece long, before long, formatted string, starts array<int>, ends array<int>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the formatted pieces alone, in
    whatever order they are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        rows, now, state = [], None, None

        def done() -> None:
            if state:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def table() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for conv, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "starts", "ends")), strict=True):
                if state is None or conv != now:
                    done()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for s, e in zip(starts, ends, strict=True):
                    role, said, _, _ = read_span(text[s:e])
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                    if role == "assistant":
                        state[2] += len(said)
                        state[3].update(said.encode())
                state[4] += len(text)
            yield table()
            rows.clear()
        done()
        yield table()

    pieces = bound_batches(formatted).select("conv_id", "piece", "formatted", "starts", "ends")
    dealt = pieces.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
