"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Turn k's span is found by
rendering the first k turns and comparing with the output for k - 1 turns: what was added is its span.
If the earlier output is no longer a prefix, the template rewrote history, which is reported. Where the
text lies inside the span is found by rendering once more with a marker in place of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PROBE = ""
WHOLE_TURNS = 64  # of the built-in template so many prefixes are rendered whole before shorter contexts may stand for them

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_MARK = re.compile(r"\\(\\)?")
_ROLE = re.compile(r"\\(\\|n)?")


def escape(text: str) -> str:
    """Double backslashes, then put one after the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: m[1] or "", text)


def render_marked(turns: list[Turn]) -> str:
    """The built-in template: every turn between marks, its role on the first line."""
    return "".join(f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def read_marked(formatted: str) -> Iterator[Turn]:
    """The turns of a text made by render_marked."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line + 1)
        role = _ROLE.sub(lambda m: {"\\": "\\", "n": "\n"}.get(m[1], ""), formatted[at + len(OPEN) : line])
        yield role, unescape(formatted[line + 1 : end])
        at = end + len(CLOSE) + 1


def _inner(render: Render, before: list[Turn], turn: Turn, after: list[Turn], out: str) -> tuple[int, int] | None:
    """Where the text of `turn` lies in `out`, the rendering of before + [turn] + after."""
    probe = PROBE
    while probe in out:
        probe += PROBE
    marked = render([*before, (turn[0], probe), *after])
    head, found, tail = marked.partition(probe)
    if found and out.startswith(head) and out.endswith(tail) and len(head) + len(tail) <= len(out):
        return len(head), len(out) - len(tail)
    return None


def locate(render: Render, turns: list[Turn], whole_turns: int | None = WHOLE_TURNS) -> tuple[str, list[tuple[int, int] | None], list[int]]:
    """(output, span of each turn's text in it or None, numbers of turns that rewrote what stood before).

    Rendering every prefix costs the square of the length. With whole_turns None every prefix is rendered,
    so every rewrite is found. With a number, after so many turns, if every turn so far added the same as in
    the context of the two turns before it, later turns are rendered in that context; the joined result,
    from the first turn on, must equal the rendering of the whole conversation, else all prefixes are
    rendered. That suits templates that treat a turn alike wherever it stands, as the built-in one does: a
    rewrite in a longer prefix that is undone by the end is not seen then.
    """
    whole_turns = len(turns) if whole_turns is None else whole_turns
    final = render(turns)

    def walk(short: bool):
        spans, rewrote = [], []
        last, at, same = render([]), len(render([])), True
        for k, turn in enumerate(turns):
            near = turns[max(0, k - 2) : k]
            if short and k >= whole_turns:
                if not same or not final.startswith(last):
                    return None
                old, new = render(near), render([*near, turn])
                inner = _inner(render, near, turn, [], new)
                if not new.startswith(old) or inner is None:
                    return None
                spans.append((at + inner[0] - len(old), at + inner[1] - len(old)))
                at += len(new) - len(old)
                if not final.startswith(new[len(old) :], at - len(new) + len(old)):
                    return None
                continue
            out = render(turns[: k + 1])
            if not out.startswith(last):
                rewrote.append(k)
            elif short and k >= 2:
                old, new = render(near), render([*near, turn])
                same = same and new.startswith(old) and new[len(old) :] == out[len(last) :]
            spans.append(_inner(render, turns[:k], turn, [], out))
            last, at = out, len(out)
        if short and (rewrote or at != len(final)):
            return None
        return spans, rewrote

    found = walk(len(turns) > whole_turns)
    if found is None:
        found = walk(False)
    spans, rewrote = found
    if rewrote:  # positions in a prefix say nothing about the whole then
        spans = [_inner(render, turns[:k], t, turns[k + 1 :], final) for k, t in enumerate(turns)]
    return final, spans, rewrote


FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, rewrites int"


def format_conversations(conversations: DataFrame, render: Render = render_marked, every_prefix: bool | None = None) -> DataFrame:
    """FORMATTED's columns, one row for each conv_id of conversations(conv_id, turn, role, text).

    Rows are ordered by turn, then role and text; a null turn comes first. Null role and text are empty.
    Rows with a null conv_id are one conversation. loss_spans are the assistant texts, in code points of
    the output. rewrites counts the turns that changed earlier output. Rows arrive sorted, so a task holds
    one conversation at a time, however long. Tied rows are in order of role and text, repeated ones are
    turns of their own. An empty table gives an empty result. Other columns are not looked at.

    every_prefix: whether every prefix is rendered whole (see locate). By default that is so for every
    template but the built-in one, whose turns are formatted alike wherever they stand.
    """
    whole_turns = None if (render is not render_marked if every_prefix is None else every_prefix) else WHOLE_TURNS
    small_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        def made(key, turns):
            out, spans, rewrote = locate(render, turns, whole_turns)
            loss = [{"start": s[0], "end": s[1]} for s, t in zip(spans, turns, strict=True) if t[0] == "assistant" and s is not None]
            return key, out, loss, len(rewrote)

        def batch(found):
            kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["conv_id", "formatted", "loss_spans", "rewrites"])

        key, turns, found, size = None, [], [], 0
        for b in batches:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if turns and c != key:
                    found.append(made(key, turns))
                    size += len(found[-1][1])
                    turns = []
                    if size > 4_000_000:
                        yield batch(found)
                        found, size = [], 0
                key = c
                turns.append((role, text))
        if turns:
            found.append(made(key, turns))
        if found:
            yield batch(found)

    return rows.mapInArrow(run, FORMATTED)


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""

    def run(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in read_marked(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    chars += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
                rows.append((n, turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return format_conversations(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
