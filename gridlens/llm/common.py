"""Session settings, table reading and byte-level text helpers shared by the operators.

Texts reach Python as Arrow batches.  The helpers below look at a batch's string
column as one flat ``uint8`` buffer plus row offsets, so tokenising and hashing are
array operations and no Python string is made for a document.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

#: Rows and bytes of an Arrow batch handed to a Python worker; texts may be long.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}
#: Bytes of text that the array helpers look at together (a longer text is one slice).
SLICE_BYTES = 512 << 10


def prepare(spark: SparkSession) -> SparkSession:
    for k, v in BATCH_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(prepare(spark), sf_dir, name)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(run):
    """A ``mapInArrow`` function that gives its memory back to the system at its end.

    Python workers are reused by later tasks and stages; what a task freed would otherwise stay with its worker.
    """
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if libc := _libc():
                libc.malloc_trim(0)

    return wrapped


def _libc():
    """The C library, if it is one with malloc_trim."""
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim
        return libc
    except (AttributeError, OSError):
        return None


def as_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) only, null texts as empty: other columns can't clash with an operator's own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


# ------------------------------------------------------------------ flat text buffers
def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (first, last + 1) whose texts have at most ``limit`` bytes together."""
    n, first = len(offs) - 1, 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, offsets) of a text column, slice by slice."""
    raw, offs = flat(column)
    for a, b in slices(offs, limit):
        yield a, b, raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a]


# ------------------------------------------------------------------ hashing
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (grown by doubling, kept per worker)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = np.ones(1, U)
        while len(have) < size:
            have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finaliser (xor-shift multiply), elementwise."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums H with H[j] - H[i] = sum of (byte + 1) * base**k over [i, j)."""
    out = np.empty(len(raw) + 1, U)
    out[0] = 0
    np.cumsum((raw.astype(U) + U(1)) * powers(_BASE, len(raw)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[starts:ends] from its prefix sums; equal strings give equal hashes.

    A polynomial modulo 2**64 in time independent of the span: some different strings (Thue-Morse words) share a
    value, so it may only choose or deal places, never tell that strings are equal; ``string_hash`` does that.
    """
    inverse = powers(_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


#: Bytes up to which strings are hashed together, eight bytes a round; longer ones one by one.
TOGETHER = 128


def string_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[starts:ends]: all bytes go through a mixer (long strings through BLAKE2b)."""
    n = ends - starts
    h = mix(n.astype(U) + U(0x2545F4914F6CDD1D))
    eight = np.ndarray(len(raw), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,)) if len(raw) else np.zeros(0, U)
    at = np.flatnonzero((n > 0) & (n <= TOGETHER))
    done = 0
    while len(at):
        left = n[at] - done
        chunk = eight[starts[at] + done]
        short = left < 8
        chunk[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        h[at] = mix((h[at] ^ chunk) * U(0x9FB21C651E98DF25) + U(done))
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(n > TOGETHER):
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return h


# ------------------------------------------------------------------ words
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_spans(raw: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of the words ``[^\\x20\\x09-\\x0D]+``; words end with their row.

    ``space`` says which bytes stand between words.
    """
    inside = ~space[raw]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(raw))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def row_of(offs: np.ndarray) -> np.ndarray:
    """The row of each element under row offsets ``offs``."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-word shingle of word hashes; a row of 1 to n - 1 words is one shingle."""
    count = np.diff(first)
    rows = row_of(first)
    left = first[1:][rows] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    at = np.flatnonzero(left >= n)
    h = np.zeros(len(at), U)
    for k in range(n):
        h = mix(h * U(0x9FB21C651E98DF25) + words[at + k])
    out_rows, out = rows[at], h
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), U)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] = mix(extra[has] * U(0x9FB21C651E98DF25) + words[first[:-1][short[has]] + k])
        extra = mix(extra ^ (count[short].astype(U) * U(0xC2B2AE3D27D4EB4F)))
        out_rows, out = np.concatenate([out_rows, short]), np.concatenate([out, extra])
    return out_rows, out


def distinct_per_row(rows: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(values sorted by row then value without repeats, row offsets)."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    r, v = r[keep], v[keep]
    return v, np.searchsorted(r, np.arange(n_rows + 1))


def shingle_sets(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each lower-cased (A-Z) text: (hashes, row offsets)."""
    low = lower_ascii(raw)
    starts, ends, first = word_spans(low, offs)
    words = string_hash(low, starts, ends)
    rows, values = shingles(words, first, n)
    return distinct_per_row(rows, values, len(offs) - 1)
