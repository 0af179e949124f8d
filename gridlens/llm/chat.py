"""Chat formatting by incremental black-box rendering (operator 2).

A template is any function from a list of (role, text) turns to a string; nothing else is known of
it.  Successive prefixes of a conversation are rendered and consecutive outputs compared: what a
turn adds to the previous output is its span, and an output that doesn't begin with the previous
one shows a template that rewrites history.  Inside a turn's span its text is found by rendering
the same prefix with a marker in place of the text.

Prefixes grow with the conversation, so turns of the registered template, which adds each turn by
itself, are rendered in runs of ``RUN`` turns behind the turns that open the conversation and the
run; the spans found must spell the rendering of the whole conversation exactly, else all its
prefixes are rendered in full.  The result is the same.  For other templates every prefix is
rendered, as one may rewrite history at any of them; a ``run`` can be given for those that don't.

The registered template marks turns and escapes control strings reversibly: a backslash after each
backslash and after the first character of each control string, so no control string is left in a
text, and dropping one backslash of each pair gives the text back.

Cases: a null text or role counts as empty; rows without a conversation id make one conversation
of their own; turns are ordered by turn (null first), then role and text, so ties have one order
and repeated rows are repeated turns; an empty table gives an empty result; other columns are not
looked at.  A formatted conversation is one row, so one conversation has to fit into a task; rows
arrive sorted and only one conversation is held at a time.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
#: Fixed values of the format: strings with a meaning of their own.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN ", "[/TURN]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
RUN = 32
PROBE = "\ue000\ue001probe\ue001\ue000"
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def render(turns: list[Turn]) -> str:
    """The registered template: ``<s>`` once, marked system and user turns, assistant turns up to ``</s>``."""
    out = ["<s>"]
    for role, text in turns:
        t = escape(text)
        out.append(f"[INST] {t} [/INST]" if role == "user" else f"[SYS] {t} [/SYS]" if role == "system"
                   else f" {t}</s>" if role == "assistant" else f"[TURN {len(escape(role))} {escape(role)}] {t} [/TURN]")
    return "".join(out)


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of ``render``."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        if formatted.startswith("[TURN ", at):
            name = formatted.index(" ", at + 6) + 1
            mark = name + int(formatted[at + 6:name - 1])
            role, start, close = unescape(formatted[name:mark]), mark + 2, " [/TURN]"
        else:
            role, start, close = (("user", at + 7, " [/INST]") if formatted.startswith("[INST] ", at) else
                                  ("system", at + 6, " [/SYS]") if formatted.startswith("[SYS] ", at) else ("assistant", at + 1, "</s>"))
        end = formatted.index(close, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(close)
    return turns


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _added(template: Callable, before: list[Turn], turns: list[Turn]) -> Iterator[tuple[str, int, int, bool]]:
    """What each of ``turns`` adds to the rendering of ``before``: (added, text start, text end, rewrites)."""
    seen, output = list(before), template(before)
    for role, text in turns:
        longer = template([*seen, (role, text)])
        rewrites = not longer.startswith(output)
        same = common_prefix(output, longer) if rewrites else len(output)
        added = longer[same:]
        probed = template([*seen, (role, PROBE)])
        at = probed.rfind(PROBE)
        start, tail = at - same, len(probed) - at - len(PROBE)
        # a template that cuts, trims or moves texts gives a text span only where both renderings agree around it
        sound = at >= same and tail <= len(longer) - at and longer[:at] == probed[:at] and longer[len(longer) - tail:] == probed[len(probed) - tail:]
        yield added, start if sound else -1, len(added) - tail if sound else -1, rewrites
        seen.append((role, text))
        output = longer


def run_of(template: Callable, run: int | None) -> int | None:
    """Turns rendered together: what is given, ``RUN`` for the registered template, else None for all true prefixes."""
    return RUN if run is None and template is render else run


def locate(template: Callable[[list[Turn]], str], turns: list[Turn], run: int | None = None):
    """(formatted, [(span start, span end, text start, text end)] per turn, turns that rewrite history).

    A text span holds the text as the template shows it; -1 says that probing didn't find it.
    """
    whole = template(turns)

    def spans(groups):
        out, rewriting, pieces, at = [], [], [template([])], len(template([]))
        for before, part in groups:
            for added, a, b, rewrites in _added(template, before, part):
                if rewrites:
                    rewriting.append(len(out))
                out.append((at, at + len(added), at + a if a >= 0 else -1, at + b if a >= 0 else -1))
                pieces.append(added)
                at += len(added)
        return out, rewriting, "".join(pieces)

    run = run_of(template, run)
    if run is not None and len(turns) > run:
        groups = [([], turns[:run])] + [([*turns[:2], *turns[i - 2:i]], turns[i:i + run]) for i in range(run, len(turns), run)]
        out, rewriting, spelled = spans(groups)
        if not rewriting and spelled == whole:
            return whole, out, rewriting
    out, rewriting, spelled = spans([([], turns)])
    if rewriting:  # spans of earlier turns are stale: say where turns stand in the last output, if they do
        out = [(s if whole[s:e] == spelled[s:e] else -1, e if whole[s:e] == spelled[s:e] else -1, -1, -1) for s, e, _, _ in out]
    return whole, out, rewriting


def conversations_of(batches):
    """(id, turns) of sorted (id, role, text) batches, one conversation at a time."""
    now, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and conv != now:
                yield now, turns
                turns = []
            now, begun = conv, True
            turns.append((role, text))
    if begun:
        yield now, turns


FORMATTED = ("conv_id long, n_turns long, formatted string, spans array<struct<role:string,start:long,stop:long,text_start:long,text_stop:long>>, "
             "rewrites array<long>")
_SPAN = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("text_start", pa.int64()), ("text_stop", pa.int64())]))


def format_chats(rows: DataFrame, template: Callable[[list[Turn]], str] = render, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", run: int | None = None) -> DataFrame:
    """One row per conversation: the formatted text, each turn's span and text span, and rewriting turns."""
    run = run_of(template, run)

    def work(batches):
        rows, held = [], 0
        types = (pa.int64(), pa.int64(), pa.string(), _SPAN, pa.list_(pa.int64()))
        names = ["conv_id", "n_turns", "formatted", "spans", "rewrites"]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for conv, turns in conversations_of(batches):
            whole, spans, rewriting = locate(template, turns, run)
            rows.append((conv, len(turns), whole, [dict(role=r, start=a, stop=b, text_start=x, text_stop=y) for (r, _), (a, b, x, y) in zip(turns, spans)], rewriting))
            held += len(whole)
            if held > 4 << 20:
                yield pack()
                rows, held = [], 0
        if rows:
            yield pack()

    clean = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a conversation's turns meet in one task in order; sorting spills, so that task streams them
    ordered = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(work, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long"


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns, and the text under the loss mask (assistant texts)."""
    def work(batches):
        import hashlib
        for batch in batches:
            rows = []
            for conv, text, spans, rewriting in zip(*(c.to_pylist() for c in batch.columns)):
                turns = read_back(text)
                loss = "".join(unescape(text[s["text_start"]:s["text_stop"]]) for s in spans if s["role"] == "assistant")
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                             len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(rewriting)))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in DIGEST.split(", ")])

    return formatted.select("conv_id", "formatted", "spans", "rewrites").mapInArrow(work, DIGEST)
