"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover (operator 6).

Every start of a ``length``-byte string (a window) is a suffix.  Suffixes are dealt to buckets by
the minimizer of their window (the k-byte string with the least hash in it), which equal windows
share, and buckets are sorted one block at a time:

1. Consecutive windows of a text with one minimizer are a run; its region is the text they cover.
   Regions of equal content (128 bits
   of BLAKE2b over all their bytes) are one class.  Minimizers found once can't have equal windows.
2. A class with two members is repeated as a whole.  Only minimizers with several classes need
   sorting: one region of each class goes to the minimizer's bucket.
3. A block of buckets is sorted by the first ``V`` bytes of its suffixes; ties are resolved by
   ranks of the cover sample, computed before for the block's text: positions whose residue modulo
   ``V`` lies in a difference cover, so any two suffixes have a shift below ``V`` that takes both to
   sample positions.  Neighbours in the order that share ``length`` bytes are repeated.
4. A bucket of over ``HOT`` regions would not fit a block; its windows are counted one by one by a
   128-bit hash of their bytes in a grouped aggregation instead, which gives the same windows.

A task holds one block (``BLOCK`` bytes, or one bucket of at most ``HOT`` regions) and its sample.

Cases: a null text counts as empty; texts under ``length`` bytes have no window; ties (equal
windows) are what is looked for; rows repeated with one id and text are repeated texts; null ids
are allowed; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, as_text, lean, mix, prefix_hash, span_hash, stored, text_slices

LENGTH, V = 400, 32
BLOCK, HOT = 1 << 20, 4000
#: Rows of one key that a task joins, and the most keys with more of them.
SPLIT, MOST_FREQUENT = 10_000, 1_000_000
#: Bytes of ids and spans up to which they are sent to all executors; beyond, texts are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of one text that are looked at together, and the bits that hold a place in them.
CHUNK = 1 << 20
PLACE = (1 << 21) - 1


def difference_cover(v: int) -> list[int]:
    """Residues whose differences are all residues modulo ``v``, added greedily."""
    cover, have = [0], {0}
    while len(have) < v:
        best = max(range(1, v), key=lambda c: (len({(c - d) % v for d in cover} | {(d - c) % v for d in cover} | have), -c))
        have |= {(best - d) % v for d in cover} | {(d - best) % v for d in cover}
        cover.append(best)
    return sorted(cover)


def shifts(v: int, cover: list[int]) -> np.ndarray:
    """[i, j] -> least shift that takes residues i and j into the cover."""
    inside = set(cover)
    return np.array([[next(s for s in range(v) if (i + s) % v in inside and (j + s) % v in inside) for j in range(v)] for i in range(v)])


COVER = difference_cover(V)
SHIFT = shifts(V, COVER)


# ------------------------------------------------------------------ runs of windows with one minimizer
def runs_of(raw: np.ndarray, offs: np.ndarray, length: int, k: int):
    """(row, first window, last window, minimizer place, minimizer hash) of each run of a slice."""
    n = len(raw)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),)
    prefix = prefix_hash(raw)
    at = np.arange(n - k + 1)
    h = span_hash(prefix, at, at + k)
    key = (h & ~U(PLACE)) | at.astype(U)
    least, size, span = key, 1, length - k + 1
    while size * 2 <= span:  # minima over windows of 2, 4, 8, ... places
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[:len(least) - (span - size)], least[span - size:])
    place = (least & U(PLACE)).astype(np.int64)  # of window p, for p in [0, n - length]
    lengths = np.diff(offs)
    long_rows = np.flatnonzero(lengths >= length)
    valid = np.zeros(len(place) + 1, np.int8)
    np.add.at(valid, offs[:-1][long_rows], 1)
    np.add.at(valid, offs[1:][long_rows] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    starts = valid.copy()
    starts[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    starts[offs[:-1][long_rows]] = True
    lo = np.flatnonzero(starts)
    row = np.searchsorted(offs, lo, "right") - 1
    hi = np.minimum(np.append(lo[1:], len(place)) - 1, offs[1:][row] - length)
    return row, lo, hi, place[lo], h[place[lo]]


def find_runs(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(doc_id, key, lo, hi, t, f, c): runs of (doc_id, key, text) rows; t is the minimizer's distance from lo, c the region's BLAKE2b."""
    def run(batches):
        for batch in batches:
            for a, b, raw, offs in text_slices(batch.column(2)):
                for x in range(0, max(1, len(raw) - length + 1), CHUNK - length + 1):  # a text longer than a chunk
                    if len(raw) <= CHUNK:
                        part, part_offs = raw, offs
                    else:
                        part = raw[x:x + CHUNK]
                        part_offs = np.array([0, len(part)])
                    row, lo, hi, place, f = runs_of(part, part_offs, length, k)
                    data = memoryview(part)
                    c = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(lo.tolist(), (hi + length).tolist())]
                    start = part_offs[:-1][row] - (x if len(raw) > CHUNK else 0)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(a, b - a).take(at), batch.column(1).slice(a, b - a).take(at), pa.array(lo - start), pa.array(hi - start),
                        pa.array((place - lo).astype(np.int32)), pa.array(f.view(np.int64)), pa.array(c, pa.binary())],
                        names=["doc_id", "key", "lo", "hi", "t", "f", "c"])
                    if len(raw) <= CHUNK:
                        break

    return texts.mapInArrow(lean(run), "doc_id long, key long, lo long, hi long, t int, f long, c binary")


# ------------------------------------------------------------------ sorting a block
def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one big-endian number."""
    out = np.zeros(len(text) - 7, U)
    for i in range(8):
        out |= text[i:len(text) - 7 + i].astype(U) << U(56 - 8 * i)
    return out


def _names(*columns: np.ndarray) -> np.ndarray:
    """Order-preserving numbers of the rows of key columns, the first column first."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), np.int64)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(w: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the cover sample's suffixes by their first ``depth`` or more bytes, spread over [0, n]."""
    inside = np.zeros(V, bool)
    inside[COVER] = True
    at = np.flatnonzero(inside[np.arange(n) % V])
    rank = np.full(n + depth + V + 1, -1, np.int64)
    rank[at] = _names(*(w[at + 8 * i] for i in range(V // 8)))
    size = V
    while size < depth:  # a sample position plus a multiple of V is one, too
        rank[at] = _names(rank[at], rank[np.minimum(at + size, n + depth)])
        size *= 2
    return rank


def repeated(text: np.ndarray, bucket: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``windows`` (positions) of a block have an equal one in their bucket.

    ``text`` ends with at least 2 * length + V zero bytes that belong to no window.
    """
    w = words_at(text)
    n = len(text) - 2 * length - V
    rank = sample_ranks(w, n, length)
    # the first V bytes of each bucket's suffixes
    order = np.lexsort([*(w[windows + 8 * i] for i in range(V // 8 - 1, -1, -1)), bucket])
    p, b = windows[order], bucket[order]
    differs = b[1:] != b[:-1]
    for i in range(V // 8):
        x = w[p + 8 * i]
        differs |= x[1:] != x[:-1]
    group = np.concatenate([[0], np.cumsum(differs)])
    # ties: partition each group by a pivot, comparing the sample ranks at the pair's common shift
    low = np.zeros(len(p), np.int64)  # place in the group's order found so far
    sizes = np.bincount(group)
    active = np.flatnonzero(sizes[group] > 1)
    g = group[active]
    rng = np.random.default_rng(1)
    while len(active):
        by = np.argsort(g, kind="stable")
        active, g = active[by], g[by]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        count = np.diff(np.append(first, len(g)))
        pivot = p[active[first + (rng.random(len(first)) * count).astype(np.int64)]]
        q, of = p[active], np.repeat(pivot, count)
        s = SHIFT[q % V, of % V]
        a, c = rank[q + s], rank[of + s]
        side = np.sign(a - c)  # -1 below, 0 tied to full depth, 1 above
        cell = np.repeat(np.arange(len(first)), count) * 3 + side + 1
        each = np.bincount(cell, minlength=3 * len(first)).reshape(-1, 3)
        before = np.concatenate([np.zeros((len(first), 1), np.int64), np.cumsum(each, axis=1)[:, :2]], axis=1).ravel()
        low[active] += before[cell]
        keep = (side != 0) & (each.ravel()[cell] > 1)
        active, g = active[keep], cell[keep]
    order2 = np.lexsort([low, group])
    p, group = p[order2], group[order2]
    # neighbours with ``length`` bytes in common
    pair = np.flatnonzero(group[1:] == group[:-1])
    for i in [*range(0, length - 7, 8), length - 8]:
        pair = pair[w[p[pair] + i] == w[p[pair + 1] + i]]
    hit = np.zeros(len(p), bool)
    hit[pair] = True
    hit[pair + 1] = True
    out = np.zeros(len(p), bool)
    out[order[order2]] = hit
    return out


def sort_block(rows: list[tuple], length: int) -> list[tuple]:
    """(doc_id, key, lo, hi) of repeated window runs; rows are (doc_id, key, lo, f, region bytes)."""
    sizes = np.array([len(r[4]) for r in rows])
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(r[4] for r in rows) + bytes(2 * length + V), np.uint8)
    n = sizes - length + 1
    windows = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    bucket = np.repeat(np.array([r[3] for r in rows], np.int64), n)
    hit = repeated(text, bucket, windows, length)
    of = np.repeat(np.arange(len(rows)), n)
    inside = windows - starts[of]
    begin = hit.copy()
    begin[1:] &= ~(hit[:-1] & (of[1:] == of[:-1]))
    end = hit.copy()
    end[:-1] &= ~(hit[1:] & (of[1:] == of[:-1]))
    return [(rows[r][0], rows[r][1], rows[r][2] + int(x), rows[r][2] + int(y))
            for r, x, y in zip(of[begin], inside[begin], inside[end])]


# ------------------------------------------------------------------ the operator
def _joined(texts: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """(doc_id, key, text) rows with their (f_doc_id, f_key, spans) facts; facts go to all executors if small."""
    size = facts.agg(F.sum(24 + 24 * F.size("spans"))).first()[0] or 0
    same = texts.key.eqNullSafe(facts.f_key) & texts.doc_id.eqNullSafe(facts.f_doc_id)
    return texts.join(F.broadcast(facts) if size <= BROADCAST_BYTES else facts, same, how).drop("f_doc_id", "f_key")


def _spans_by_text(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(F.col("doc_id").alias("f_doc_id"), F.col("key").alias("f_key")).agg(F.collect_list(F.struct(*columns)).alias("spans"))


def _split_join(rows: DataFrame, small: DataFrame, keys: dict[str, str], count: str, how: str, split: int = SPLIT) -> DataFrame:
    """``rows`` joined with stored ``small``, which has a row per key and how many rows of it there are in ``count``.

    Rows of a frequent key are dealt to parts of ``split`` rows, to each of which the key's one row of
    ``small`` is copied.  Frequent keys are at most ``MOST_FREQUENT``, as ``split`` grows with all rows
    beyond that, so their table may go to all executors.  (merge: ``small`` grows with the input; a
    broadcast that only small inputs get would change nothing at scale)
    """
    split = max(split, (small.agg(F.sum(count)).first()[0] or 0) // MOST_FREQUENT)
    parts = F.ceil(F.col(count) / split).cast("int")
    frequent = small.filter(F.col(count) > split).select(*[F.col(c).alias(f"q_{c}") for c in keys.values()], parts.alias("q_parts"))
    found = [F.col(a) == F.col(f"q_{b}") for a, b in keys.items()]
    part = F.when(F.col("q_parts").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("q_parts"))).otherwise(0).cast("int")
    dealt = rows.join(F.broadcast(frequent), functools.reduce(Column.__and__, found), "left").withColumn("q_part", part)
    copies = small.withColumn("q_copy", F.explode(F.sequence(F.lit(0), parts - 1)))
    same = [F.col(a) == F.col(b) for a, b in keys.items()] + [F.col("q_part") == F.col("q_copy")]
    out = dealt.join(copies.hint("merge"), functools.reduce(Column.__and__, same), how)
    return out.drop(*[f"q_{c}" for c in keys.values()], "q_parts", "q_part", "q_copy")


def repeated_windows(texts: DataFrame, length: int = LENGTH, k: int | None = None, hot: int = HOT, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """(doc_id, key, lo, hi): runs of starts of repeated strings of (doc_id, key, text) rows.

    ``k`` is the bytes of a minimizer, a third of ``length`` by default: so long
    that it seldom repeats by chance, or more and more would as the corpus grows.
    """
    k = k or max(1, length // 3)
    runs = stored(find_runs(texts, length, k), "runs")
    # minimizers found more than once, and their classes of equal regions
    again = stored(runs.groupBy(F.col("f").alias("a_f")).agg(F.count("*").alias("n")).filter("n > 1"), "again")
    runs = stored(_split_join(runs, again, {"f": "a_f"}, "n", "left_semi", split), "runs")
    first = F.min(F.struct("doc_id", "key", "lo", "hi")).alias("one")
    classes = stored(runs.groupBy("f", "c", "t").agg(F.count("*").alias("n"), first), "classes")
    whole = classes.filter("n > 1").select(F.col("f").alias("w_f"), F.col("c").alias("w_c"), F.col("t").alias("w_t"), "n")
    out = _split_join(runs, whole, {"f": "w_f", "c": "w_c", "t": "w_t"}, "n", "left_semi", split).select("doc_id", "key", "lo", "hi")
    several = stored(classes.groupBy(F.col("f").alias("s_f")).agg(F.count("*").alias("m")).filter("m > 1"), "several")
    regions = _split_join(classes.drop("n"), several, {"f": "s_f"}, "m", "inner", split)
    regions = regions.select("one.*", "f", "t", F.col("m") > hot).toDF("doc_id", "key", "lo", "hi", "f", "t", "big")
    regions = stored(regions, "regions")
    wanted = stored(_spans_by_text(regions, "lo", "hi", "f", "t", "big"), "wanted")
    # copies of a wanted row carry equal text: one of them is enough
    rows = _joined(texts, wanted, "inner")

    def cut(batches):
        for batch in batches:
            cells = ([], [], [], [], [], [], [])
            for doc_id, key, spans, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(2)):
                data = text.as_buffer().to_pybytes()
                for s in spans:
                    for c, x in zip(cells, (doc_id, key, s["lo"], s["f"], s["t"], s["big"], data[s["lo"]:s["hi"] + length])):
                        c.append(x)
                if len(cells[0]) > 4000:
                    yield pack(cells)
                    cells = ([], [], [], [], [], [], [])
            yield pack(cells)

    def pack(cells):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], names=["doc_id", "key", "lo", "f", "t", "big", "region"])

    regions = stored(rows.mapInArrow(lean(cut), "doc_id long, key long, lo long, f long, t int, big boolean, region binary"), "regions")

    def sort(batches):
        held, size, done = [], 0, lambda found: pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], pa.int64()) for i in range(4)], names=["doc_id", "key", "lo", "hi"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= block and row[3] != held[-1][3]:
                    yield done(sort_block(held, length))
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done(sort_block(held, length))

    buckets = regions.filter("not big").select("doc_id", "key", "lo", "f", "region").repartition("f").sortWithinPartitions("f", "doc_id", "key", "lo")
    out = out.union(buckets.mapInArrow(lean(sort), "doc_id long, key long, lo long, hi long"))
    return out.union(hot_windows(regions.filter("big"), length))


def hot_windows(regions: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, lo, hi) of repeated windows of large buckets, counted by hash."""
    def explode(batches):
        for batch in batches:
            for doc_id, key, lo, f, _, _, region in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(region) - length + 1
                sums = [hashlib.blake2b(region[i:i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int64()),
                                                  pa.array(sums, pa.binary())], names=["doc_id", "key", "lo", "h"])

    rows = regions.select("doc_id", "key", "lo", "f", "t", "big", "region").mapInArrow(lean(explode), "doc_id long, key long, lo long, h binary")
    twice = rows.groupBy(F.col("h").alias("t_h")).agg(F.count("*").alias("n")).filter("n > 1").select("t_h")
    return rows.join(twice, F.col("h") == F.col("t_h"), "left_semi").select("doc_id", "key", "lo", F.col("lo").alias("hi"))


def merge_spans(spans, length: int) -> list[tuple[int, int]]:
    """Maximal removed [start, end) runs of sorted or unsorted runs of window starts."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [tuple(x) for x in out]


def merged_runs(facts: DataFrame, length: int) -> DataFrame:
    """(f_doc_id, f_key, spans) with touching runs of each text joined: few, where whole texts are repeated."""
    def run(batches):
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in batches:
            lists = [[{"lo": a, "hi": b - length} for a, b in merge_spans([(s["lo"], s["hi"]) for s in spans], length)] for spans in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, kind)], names=["f_doc_id", "f_key", "spans"])

    return facts.mapInArrow(lean(run), "f_doc_id long, f_key long, spans array<struct<lo:long,hi:long>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                   as_string: bool = False, **limits) -> DataFrame:
    """(doc_id, the ``keep`` columns, n_bytes, n_removed, n_spans, spans, rest) per row.

    ``rest`` holds the remaining bytes, or with ``as_string`` their text without characters cut in two.
    """
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    wide = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), own).alias("key"), own.alias("text"),
                       *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    found = stored(repeated_windows(wide.select("doc_id", "key", "text"), length, **limits), "repeats")
    merged = stored(merged_runs(_spans_by_text(found, "lo", "hi"), length), "repeats")
    extra = [f"kept_{i}" for i in range(len(keep))]

    def cut(batches):
        for batch in batches:
            column = len(extra) + 1
            lists, rest, sizes = [], [], []
            for text, spans in zip(batch.column(column), batch.column(column + 1).to_pylist()):
                data = text.as_buffer().to_pybytes()
                gone = merge_spans([(s["lo"], s["hi"]) for s in spans], length) if spans else []
                edges = [0, *(x for s in gone for x in s), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if gone else data
                rest.append(left.decode("utf-8", "ignore") if as_string else left)
                lists.append([{"start": a, "stop": b} for a, b in gone])
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(column)), pa.array(sizes, pa.int64()), pa.array([sum(s["stop"] - s["start"] for s in x) for x in lists], pa.int64()),
                pa.array(map(len, lists), pa.int64()), pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array(rest, pa.string() if as_string else pa.binary())],
                names=["doc_id", *extra, "n_bytes", "n_removed", "n_spans", "spans", "rest"])

    rows = _joined(wide, merged, "left").select("doc_id", *extra, "text", "spans")
    schema = ", ".join(["doc_id long", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra), "n_bytes long, n_removed long, n_spans long",
                        "spans array<struct<start:long,stop:long>>, rest " + ("string" if as_string else "binary")])
    return rows.mapInArrow(lean(cut), schema).withColumnsRenamed(dict(zip(extra, keep)))
