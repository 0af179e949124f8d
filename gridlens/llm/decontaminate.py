"""Benchmark decontamination by CGK embeddings and bit-sampling LSH (operator 3).

Texts are rows of words (letters, digits and bytes from 0x80 on; A-Z lower-cased).  An item is
found in a document if some passage of it is within ``floor(0.2 * words)`` word edits of the item.

- Embedding: a walk reads a string from its start; at each step it outputs the word it stands on
  and moves on if a random bit of (step, word) is set.  Edit distance becomes Hamming distance:
  walks over similar strings stay on equal words for most steps (Chakraborty, Goldenberg, Koucky).
- Tables: each of ``WALKS`` independent walks feeds ``TABLES`` tables, a key joining the first
  output and ``BITS`` outputs at sampled steps.  Items are indexed by windows from ``STARTS`` of
  their words on (rare ones in the first half), so one edit at a start doesn't lose an item.  Steps
  are sampled within the window's size (2, 3, 4, 6, 8, 12, .. words, the largest within what is left of the item), so
  windows are item-sized, however long the item.
- Document windows start at every word.  As a key holds the walk's first word, only windows that
  start with an indexed word can meet an item; the others needn't be walked.
- Windows that meet an item in a table are verified by exact edit distance against the whole item.

Items go to the executors in blocks of ``BLOCK_BYTES``; every block meets all documents.

Cases: null texts count as empty; items without words are found nowhere; items of under ``EXACT``
words must occur exactly; null ids are kept as they are; a repeated item or document gives repeated
rows; of overlapping passages with one item the nearest is returned, then the first; empty tables
give empty results; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, as_text, lean, lower_ascii, mix, string_hash, text_slices, word_spans

WALKS, TABLES, BITS, STARTS = 4, 4, 2, 5
#: Edits allowed per word, and words below which an item must occur exactly.
EDITS, EXACT = 0.2, 8
BLOCK_BYTES = 2 << 20
#: Steps of a walk per word of the window.
PACE = 1.6
_GAP = np.ones(256, bool)
_GAP[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def words_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each row, starts, ends) of a slice of texts."""
    low = lower_ascii(raw)
    starts, ends, first = word_spans(low, offs, _GAP)
    return string_hash(low, starts, ends), first, starts, ends


def window_size(words: int) -> int:
    """The largest of 2, 3, 4, 6, 8, 12, 16, .. words that is no longer than ``words`` (2 at least)."""
    two = 1 << max(1, words.bit_length() - 1)
    return two * 3 // 2 if two * 3 <= words * 2 else two


def _samples(steps: int) -> np.ndarray:
    """[walk, table, bit] sampled steps below ``steps``, sorted within a table, never the first."""
    rng = np.random.default_rng(steps)
    return np.sort(rng.integers(1, max(2, steps), (WALKS, TABLES, BITS)), axis=2)


def keys(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """[window, walk * table] keys of the windows of a size class that begin at ``starts``; ``stops`` end their texts."""
    steps = max(2, int(PACE * size))
    samples = _samples(steps)
    out = np.zeros((len(starts), WALKS, TABLES), U)
    for walk in range(WALKS):
        at = starts.copy()
        here = words[at]
        key = [mix(here + U(size * 1000 + walk * TABLES + t + 1)) for t in range(TABLES)]
        last = int(samples[walk].max())
        bits = mix(here ^ U(0xA0761D6478BD642F * (walk + 1) & (1 << 64) - 1))
        for step in range(last):
            at = at + ((bits >> U(step % 61)) & U(1)).astype(np.int64)
            inside = at < stops
            here = np.where(inside, words[np.minimum(at, len(words) - 1)], U(0))
            bits = mix(here ^ U((0xA0761D6478BD642F * (walk + 1) + step + 1) & (1 << 64) - 1))
            for t in range(TABLES):
                for _ in range(int((samples[walk, t] == step + 1).sum())):
                    key[t] = mix(key[t] * U(0x9FB21C651E98DF25) + here)
        out[:, walk] = np.stack(key, axis=1)
    return out.reshape(len(starts), -1)


@dataclass
class Index:
    """Indexed windows of a block of items."""
    ids: list
    words: np.ndarray
    first: np.ndarray
    begin: np.ndarray       # sorted words that windows start with
    sizes: list             # size classes of the windows that start with each
    keys: np.ndarray        # sorted keys
    window: np.ndarray      # their (item, start)


def build(ids: list, texts: list[str]) -> Index:
    raw = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    offs = np.cumsum([0, *(len(t.encode("utf-8", "surrogatepass")) for t in texts)])
    words, first, starts, ends = words_of(raw, offs)
    values, inverse, count = np.unique(words, return_inverse=True, return_counts=True)
    often, length = count[inverse], ends - starts
    items, places, classes = [], [], []
    for i in range(len(ids)):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        half = a + max(1, (b - a + 1) // 2)
        rare = np.lexsort((np.arange(a, half), -length[a:half], often[a:half]))[:STARTS] + a
        for s in sorted(rare):
            items.append(i)
            places.append(s)
            classes.append(window_size(int(b - s)))
    items, places, classes = np.array(items, np.int64), np.array(places, np.int64), np.array(classes, np.int64)
    found, where = [], []
    for size in np.unique(classes):
        at = np.flatnonzero(classes == size)
        found.append(keys(words, places[at], first[items[at] + 1], int(size)).ravel())
        where.append(np.repeat(np.stack([items[at], places[at] - first[items[at]]], axis=1), WALKS * TABLES, axis=0))
    k = np.concatenate(found) if found else np.zeros(0, U)
    window = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
    order = np.argsort(k, kind="stable")
    begin, inv = np.unique(words[places], return_inverse=True) if len(places) else (np.zeros(0, U), np.zeros(0, np.int64))
    sizes = [sorted({int(c) for c in classes[inv == j]}) for j in range(len(begin))] if len(begin) < 50_000 else _sizes(inv, classes, len(begin))
    return Index(ids, words, first, begin, sizes, k[order], window[order])


def _sizes(inv: np.ndarray, classes: np.ndarray, n: int) -> list:
    out: list[set] = [set() for _ in range(n)]
    for j, c in zip(inv.tolist(), classes.tolist()):
        out[j].add(c)
    return [sorted(x) for x in out]


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """(least word edits between ``item`` and a passage of ``text``, its start, its end); edits over ``most`` may be inexact.

    Semi-global alignment, row by row; of equal distances the first end and its latest start.
    """
    n = len(text)
    place = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), place.copy()
    for i, w in enumerate(item):
        step = np.empty(n + 1, np.int64)
        step[0] = i + 1
        diagonal = row[:-1] + (text != w)
        up = row[1:] + 1
        step[1:] = np.minimum(diagonal, up)
        start = np.empty(n + 1, np.int64)
        start[0] = 0
        start[1:] = np.where(diagonal <= up, begin[:-1], begin[1:])
        flat = step - place
        least = np.minimum.accumulate(flat)
        source = np.maximum.accumulate(np.where(flat == least, place, 0))
        row, begin = least + place, start[source]
        if row.min() > most:
            return most + 1, 0, 0
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


def search(index: Index, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, last word + 1, edits) of the passages of a slice of documents."""
    if not len(index.begin) or not len(words):
        return []
    at = np.searchsorted(index.begin, words)
    at[at == len(index.begin)] = 0
    start = np.flatnonzero(index.begin[at] == words)
    if not len(start):
        return []
    row = np.searchsorted(first, start, "right") - 1
    which = at[start]
    by_size: dict[int, list[int]] = {}
    for i, j in enumerate(which.tolist()):
        for size in index.sizes[j]:
            by_size.setdefault(size, []).append(i)
    candidates = []
    for size, places in by_size.items():
        for piece in np.array_split(np.array(places), max(1, len(places) // 20_000)):
            k = keys(words, start[piece], first[row[piece] + 1], size)
            a = np.searchsorted(index.keys, k.ravel(), "left")
            b = np.searchsorted(index.keys, k.ravel(), "right")
            n = b - a
            hit = np.flatnonzero(n)
            n = n[hit]
            item_at = np.repeat(a[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            window = index.window[item_at]
            here = piece[np.repeat(hit // k.shape[1], n)]
            candidates.append(np.stack([row[here], window[:, 0], start[here] - window[:, 1]], axis=1))
    candidates = np.unique(np.concatenate(candidates), axis=0)
    out, last, bags = [], None, {}
    for r, i, p in candidates.tolist():
        item = index.words[index.first[i]:index.first[i + 1]]
        size = len(item)
        a, b = int(first[r]), int(first[r + 1])
        if a <= p and p + size <= b and np.array_equal(words[p:p + size], item):
            found = (r, i, p - a, p - a + size, 0)
        else:
            most = int(EDITS * size) if size >= EXACT else 0
            if most == 0 or (last is not None and last[:2] == (r, i) and last[2] <= p - a + most and p - a + size - most <= last[3] and last[4] == 0):
                continue
            x, y = max(a, p - most), min(b, p + size + most)
            if i not in bags:
                bags[i] = np.unique(item)
            near = np.searchsorted(bags[i], words[x:y])
            near[near == len(bags[i])] = 0
            if np.count_nonzero(bags[i][near] == words[x:y]) < size - most:
                continue  # each kept word of the item stands in the passage
            edits, s, e = edit_distance(item, words[x:y], most)
            if edits > most:
                continue
            found = (r, i, x - a + s, x - a + e, edits)
        if last is not None and last[:2] == found[:2] and found[2] < last[3]:  # the same passage
            if found[4] < last[4]:
                out[-1] = last = found
            continue
        out.append(found)
        last = found
    return out


FOUND = "doc_id long, item_id long, start_byte long, stop_byte long, edits long, item_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start_byte, stop_byte, edits, item_words): the passages of documents that are benchmark items."""
    spark = docs.sparkSession
    items = as_text(benchmark, item_id_col, item_text_col).toDF("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    texts = as_text(docs, id_col, text_col)
    out = None
    for block in range(blocks):
        rows = numbered.filter(F.col("block") == block).sort("item_id", "text").collect()  # about block_bytes
        shared = spark.sparkContext.broadcast(build([r[0] for r in rows], [r[1] for r in rows]))
        found = texts.mapInArrow(lean(_searcher(shared)), FOUND)
        out = found if out is None else out.union(found)
    return out


def _searcher(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for a, b, raw, offs in text_slices(batch.column(1)):
                words, first, starts, ends = words_of(raw, offs)
                found = search(index, words, first)
                if not found:
                    continue
                row, item, x, y, edits = (np.array(c, np.int64) for c in zip(*found))
                from_byte = starts[first[row] + x] - offs[row]
                to_byte = ends[first[row] + y - 1] - offs[row]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(from_byte), pa.array(to_byte),
                    pa.array(edits), pa.array(index.first[item + 1] - index.first[item])], names=[f.split()[0] for f in FOUND.split(", ")])
    return run
