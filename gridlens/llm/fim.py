"""Fill-in-middle transformation over a learned rank index of unit boundaries (operator 11).

A text is cut into units (``[A-Za-z]+|[^A-Za-z]`` over code points) and two cuts, drawn from the id, split it
into prefix, middle and suffix, which are rearranged behind marks.

The boundaries of a slice of texts are kept as a piecewise-linear index: a segment predicts the byte offset of a
boundary from its rank, with an error of at most ``BOUND`` bytes over all boundary offsets it was fitted to, and one
signed byte per boundary holds the residual.  A cut is predicted and corrected by its residual, which is exact.  The index
takes about a byte per unit where plain offsets take eight, so a text of any length is held next to its index
only: it is scanned in chunks, and their offsets are given up as soon as their segments are fitted.

Marks can't arise where parts and marks meet (a mark ends with ``>``, starts with ``<``, and has neither inside), and texts
that hold one stay plain, so the output is undone by cutting it at its marks.

Cases: a null text counts as empty; an empty text stays plain with n = 0; a row without an id is drawn as if its id were
the empty string; ids alone decide the draw, so repeated rows come out alike; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, lean, text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest error of a segment's prediction in bytes (a residual is one signed byte), and bytes scanned together.
BOUND, CHUNK = 120, 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = True
_LETTER[ord("a"):ord("z") + 1] = True


@dataclass(frozen=True)
class Draw:
    """Seed of the draw; of 100 texts, how many are rearranged, and how many of those put the suffix first."""
    seed: int = 1
    rate: int = 90
    spm: int = 20


# ------------------------------------------------------------------ the index
def next_segment(y: np.ndarray, first: int) -> tuple[int, float]:
    """(end, slope) of the longest segment from y[first] on, within ``BOUND`` of every value (shrinking cone).

    The line goes through y[first]; each further point narrows the slopes that are possible, and the segment ends before the
    point that leaves none.  Points are looked at in steps of doubling size.
    """
    low, high, at, step, n = -np.inf, np.inf, first + 1, 64, len(y)
    while at < n:
        stop = min(n, at + step)
        run = np.arange(at - first, stop - first, dtype=np.float64)
        rise = (y[at:stop] - y[first]).astype(np.float64)
        lows = np.maximum(np.maximum.accumulate((rise - BOUND) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + BOUND) / run), high)
        none = lows > highs
        if none.any():
            k = int(none.argmax())
            if k:
                low, high = lows[k - 1], highs[k - 1]
            at += k
            break
        low, high, at, step = lows[-1], highs[-1], stop, step * 2
    return at, 0.0 if at == first + 1 else float((low + high) / 2)


class RankIndex:
    """Boundary offsets by rank: segments (first rank, offset there, slope) and a residual byte per rank."""

    def __init__(self):
        self.first, self.base, self.slope = [], [], []
        self.residuals: list[np.ndarray] = []
        self.n = 0

    def extend(self, offsets: np.ndarray) -> None:
        """Fit segments to the next boundary offsets, which rise."""
        at = 0
        while at < len(offsets):
            stop, slope = next_segment(offsets, at)
            predicted = np.rint(offsets[at] + slope * np.arange(stop - at)).astype(np.int64)
            self.first.append(self.n + at)
            self.base.append(int(offsets[at]))
            self.slope.append(slope)
            self.residuals.append((offsets[at:stop] - predicted).astype(np.int8))
            at = stop
        self.n += len(offsets)

    def finish(self) -> RankIndex:
        self.first, self.base, self.slope = np.array(self.first, np.int64), np.array(self.base, np.int64), np.array(self.slope)
        self.residuals = np.concatenate(self.residuals) if self.residuals else np.zeros(0, np.int8)
        return self

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of boundaries by rank: predicted by their segments, corrected by their residuals."""
        s = np.searchsorted(self.first, ranks, "right") - 1
        return np.rint(self.base[s] + self.slope[s] * (ranks - self.first[s])).astype(np.int64) + self.residuals[ranks]


def unit_starts(raw: np.ndarray, offs: np.ndarray, a: int, b: int) -> np.ndarray:
    """Places in [a, b) where a unit starts; rows start one, continuation bytes of a character never do."""
    part = raw[a:b]
    letter = _LETTER[part]
    start = (part & 0xC0) != 0x80
    before = np.empty(len(part), bool)
    before[1:] = letter[:-1]
    before[:1] = a > 0 and _LETTER[raw[a - 1]]
    start &= ~(letter & before)
    x, y = np.searchsorted(offs, a), np.searchsorted(offs, b)
    start[offs[x:y] - a] = True
    return np.flatnonzero(start) + a


def index_units(raw: np.ndarray, offs: np.ndarray, chunk: int = CHUNK) -> tuple[RankIndex, np.ndarray]:
    """The index of all boundaries of a slice's texts, and the rank of each row's first one.

    Boundary k of row i has rank first[i] + k: where a row ends the next one starts.
    """
    index, first = RankIndex(), np.zeros(len(offs), np.int64)
    for a in range(0, len(raw), chunk):
        b = min(len(raw), a + chunk)
        starts = unit_starts(raw, offs, a, b)
        x, y = np.searchsorted(offs, a), np.searchsorted(offs, b)
        first[x:y] = index.n + np.searchsorted(starts, offs[x:y])
        index.extend(starts)
    first[np.searchsorted(offs, len(raw)):] = index.n
    index.extend(np.array([len(raw)], np.int64))
    return index.finish(), first


# ------------------------------------------------------------------ the operator
def draws(ids: list, seed: int) -> np.ndarray:
    """[row, 4]: the first four 8-digit groups of sha256('seed:id') as integers."""
    sums = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(sums, ">u4").reshape(-1, 4).astype(np.int64)


def characters(raw: bytes | np.ndarray) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, draw: Draw = Draw(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches):
        p, s, m = marks
        for batch in batches:
            for a, b, raw, offs in text_slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                index, first = index_units(raw, offs)
                n, h = np.diff(first), draws(ids.to_pylist(), draw.seed)
                cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                one, two = index.at(first[:-1] + cuts[:, 0]), index.at(first[:-1] + cuts[:, 1])
                forms, parts, texts = [], ([], []), []
                for i in range(b - a):
                    text = raw[offs[i]:offs[i + 1]].tobytes()
                    if not text or any(x in text for x in marks) or h[i, 2] % 100 >= draw.rate:
                        forms.append("plain")
                        parts[0].append(None)
                        parts[1].append(None)
                        texts.append(text)
                        continue
                    x, y = int(one[i] - offs[i]), int(two[i] - offs[i])
                    spm = h[i, 3] % 100 < draw.spm
                    forms.append("spm" if spm else "psm")
                    parts[0].append(characters(text[:x]))
                    parts[1].append(characters(text[x:y]))
                    texts.append(b"".join((s, text[y:], p, text[:x], m, text[x:y]) if spm else (p, text[:x], s, text[y:], m, text[x:y])))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()),
                    pa.array(texts, pa.binary()).view(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return as_text(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of."""
    part = lambda mark, until: F.substring_index(F.substring_index(output, mark, -1), until, 1) if until else F.substring_index(output, mark, -1)
    return (F.when(form == "psm", F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX)))
            .otherwise(output))
