"""Quality rules by compression bands (operator 7).

Every whole text gets exact base counts (words, code points in words, symbols, repeated lines,
words inside repeated 8-word windows) and zstandard ratios: bytes / compressed bytes of the whole
text and of each fixed-size chunk.  A text fails when it is repetitive (a ratio above the upper
limit) or incompressible (a ratio below the lower limit); both limits depend on the number of
bytes, as longer texts compress better and short ones carry the frame's own cost.

Cases: a null text counts as empty; an empty text has no words and fails the base rule; rows are
judged one by one, so repeated rows and ties get the same verdict; an empty table gives an empty
result; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import U, as_text, lean, mix, row_of, string_hash, text_slices, word_spans

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_bytes long, doc_ratio double, max_chunk_ratio double, "
          "min_chunk_ratio double, verdict string")
#: zstandard level of both passes and the bytes of a fixed chunk.
LEVEL, CHUNK = 3, 4096
#: (bytes below which the band holds, lowest ratio, highest ratio) for whole texts and for chunks.
DOC_BANDS = ((128, 0.60, 3.0), (512, 0.85, 3.5), (2048, 1.10, 4.0), (16384, 1.20, 5.0), (1 << 62, 1.25, 6.0))
CHUNK_BANDS = ((128, 0.50, 4.0), (512, 0.80, 5.0), (2048, 1.00, 6.0), (1 << 62, 1.10, 8.0))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 8


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def base_counts(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The exact base counts of each text of a slice."""
    n = len(offs) - 1
    starts, ends, first = word_spans(raw, offs)
    n_words = np.diff(first)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1  # next to a row's end a word may start where another ends
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    # lines with a word, equal to an earlier line of the same text
    cuts = np.union1d(np.flatnonzero(raw == 10) + 1, offs[:-1])
    cuts = cuts[cuts <= len(raw)]
    line_end = np.append(cuts[1:], len(raw))
    body_end = line_end - ((line_end > cuts) & (raw[np.maximum(line_end - 1, 0)] == 10) if len(raw) else 0)
    rows = np.searchsorted(offs, cuts, "right") - 1
    has_word = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    keep = has_word[body_end] > has_word[cuts]
    rows, lines = rows[keep], string_hash(raw, cuts[keep], body_end[keep])
    order = np.lexsort((lines, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (lines[order][1:] == lines[order][:-1])
    dup_lines = np.bincount(rows[order][1:][same], minlength=n)
    # words inside a window found twice or more in the text
    words = string_hash(raw, starts, ends)
    of = row_of(first)
    at = np.flatnonzero(first[1:][of] - np.arange(len(words)) >= WINDOW) if len(words) else np.zeros(0, np.int64)
    h = np.zeros(len(at), U)
    for k in range(WINDOW):
        h = mix(h * U(0x9FB21C651E98DF25) + words[at + k])
    order = np.lexsort((h, of[at]))
    r, v = of[at][order], h[order]
    twin = np.zeros(len(order), bool)
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    twin[1:] |= same
    twin[:-1] |= same
    marks = np.zeros(len(words) + 1, np.int64)
    hit = at[order][twin]
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + WINDOW, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return {
        "n_words": n_words,
        "word_chars": _per_row(inside & ((raw & 0xC0) != 0x80), offs),
        "n_symbols": _per_row(_SYMBOL[raw], offs),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(of[covered], minlength=n),
    }


def band(n_bytes: int, bands) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if n_bytes < most)


def ratios(text: bytes, compressor, chunk: int = CHUNK) -> tuple[float, list[tuple[int, float]]]:
    """Whole-text ratio and (bytes, ratio) of each fixed chunk; a last chunk under 1/4 joins the one before."""
    whole = len(text) / len(compressor.compress(text)) if text else 1.0
    if len(text) <= chunk:
        return whole, [(len(text), whole)]
    cuts = list(range(0, len(text), chunk))
    if len(text) - cuts[-1] < chunk // 4:
        cuts.pop()
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)])]
    return whole, [(len(p), len(p) / len(compressor.compress(p))) for p in parts]


def judge(text: bytes, compressor, chunk: int = CHUNK, doc_bands=DOC_BANDS, chunk_bands=CHUNK_BANDS):
    """(verdict, document ratio, largest and smallest chunk ratio) of one text."""
    whole, parts = ratios(text, compressor, chunk)
    low, high = band(len(text), doc_bands)
    verdict = "repetitive" if whole > high else "incompressible" if whole < low else "ok"
    if verdict == "ok" and len(parts) > 1:
        for size, ratio in parts:
            low, high = band(size, chunk_bands)
            if ratio > high or ratio < low:
                verdict = "repetitive chunk" if ratio > high else "incompressible chunk"
                break
    each = [x for _, x in parts]
    return verdict, whole, max(each), min(each)


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL,
                      chunk: int = CHUNK, doc_bands=DOC_BANDS, chunk_bands=CHUNK_BANDS) -> DataFrame:
    """One row per row of ``docs``: base counts, ratios, ``verdict`` and ``kept``."""
    def run(batches):
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for a, b, raw, offs in text_slices(batch.column(1)):
                base = base_counts(raw, offs)
                view = raw.tobytes()
                judged = [judge(view[x:y], compressor, chunk, doc_bands, chunk_bands) for x, y in zip(offs[:-1], offs[1:])]
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                ok = np.array([v[0] == "ok" for v in judged], bool)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a),
                    *(pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    pa.array(failed), pa.array(ok & ~failed), pa.array(np.diff(offs)),
                    pa.array([v[1] for v in judged], pa.float64()), pa.array([v[2] for v in judged], pa.float64()),
                    pa.array([v[3] for v in judged], pa.float64()), pa.array([v[0] for v in judged], pa.string()),
                ], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return as_text(docs, id_col, text_col).mapInArrow(lean(run), SCHEMA)
