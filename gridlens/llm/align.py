"""Alignment of two tokenizers over the same texts (operator 12).

Tokenizer A is a byte-level BPE file (``tokenizers`` or, with the same vocabulary, ``tiktoken``), B a sentencepiece model; A reads a space and the text, B adds that
space itself, so the tokens of both cover the same bytes.  Per batch, the tokens of both sides are tables of
(document, start, token); ``pandas.merge_asof`` keyed by the document finds for each token start the token of the other
side that covers it.  The union of both directions holds every pair of tokens whose byte ranges overlap (of two overlapping
tokens, the one that starts later starts inside the other).  Byte offsets where a token of both sides ends cut them into groups.

Links are gathered by id pair: documents that hold the pair linked are counted over the whole corpus, and each document gets
sums over its links.  Pairs leave Python once per document; counting and joining them is a grouped
aggregation and an equi-join.  The counted pairs are sent to all executors only while they are under ``BROADCAST_BYTES``,
counted beforehand; beyond, both sides are shuffled by pair, where adaptive execution splits frequent pairs.

Cases: texts that are null, empty, or whose tokens of either side don't give a space and the text back (a text with ``U+2581``)
have no tokens; ids may be missing or stand on several rows, each row is a document; repeated rows count each;
an empty table gives an empty result; other columns are not looked at.  A text is encoded whole, in one task.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, flat, lean, row_of, slices, stored
from .pieces import ragged

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
#: Largest tokenizer file that is broadcast; bytes of counted pairs up to which they are sent to all executors, and bytes of one.
FILE_BYTES, BROADCAST_BYTES, PAIR_BYTES = 64 << 20, 64 << 20, 48
#: Bytes of text encoded together (a longer text is one slice).
SLICE = 128 << 10


# ------------------------------------------------------------------ token bytes
def byte_level() -> dict[str, int]:
    """Byte-level BPE's letter of each byte: printable ones stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(own)]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(rest)}


def bytes_of_a(file: bytes) -> list[bytes]:
    """Each id's bytes; special tokens are never produced."""
    model, letters = json.loads(file), byte_level()
    vocab = dict(model["model"]["vocab"]) | {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


def bytes_of_b(file: bytes) -> list[bytes]:
    """Each id's bytes: U+2581 is a space, <0xHH> the byte HH."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())]


class Side:
    """One tokenizer's table of token bytes, flat."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.ends = np.cumsum([0, *map(len, strings)])

    def spell(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, token ends, row offsets) of token rows, all in bytes."""
        raw, ends = ragged(self.data, self.ends[ids], self.ends[ids + 1])
        return raw, ends, np.concatenate([[0], ends])[first]


#: Words that byte-level BPE files of this kind never merge across (a fixed value of the format).
WORDS_A = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder_a(file: bytes):
    """texts -> id lists of a byte-level BPE file; special tokens are ordinary text.

    Where ids are the places of their merges, ids are all that merging needs, and
    tiktoken does it from the file's own vocabulary; else tokenizers does.
    """
    content = json.loads(file)
    model, letters = content["model"], byte_level()
    split = (content.get("pre_tokenizer") or {})
    vocab = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    in_order = [vocab.get(m) for m in merges] == list(range(256, 256 + len(merges))) and len(vocab) >= 256 + len(merges)
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not content.get("normalizer")
    if in_order and plain:
        import tiktoken
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
        encoding = tiktoken.Encoding("a", pat_str=WORDS_A, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(" " + t) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    a = Tokenizer.from_str(file.decode())
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return lambda texts: [e.ids for e in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def encoder_b(file: bytes):
    """texts -> id lists of a sentencepiece model."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    return lambda texts: model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers with their tables of token bytes."""

    def __init__(self, file_a: bytes, file_b: bytes):
        self.encode_a, self.encode_b = encoder_a(file_a), encoder_b(file_b)
        strings_a, strings_b = bytes_of_a(file_a), bytes_of_b(file_b)
        self.a, self.b = Side(strings_a), Side(strings_b)
        self.decimal = Decimal(max(len(strings_a), len(strings_b)))


_pairs: dict[bytes, Pair] = {}


def loaded(file_a: bytes, file_b: bytes) -> Pair:
    """The pair of these files; a worker keeps the last one, as its next task will want it."""
    key = hashlib.sha256(file_a).digest() + hashlib.sha256(file_b).digest()
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(file_a, file_b)
    return _pairs[key]


def joined_rows(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.cumsum([0, *map(len, lists)])
    return np.fromiter(chain.from_iterable(lists), np.int64, int(first[-1])), first


def only_rows(ids: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, those not kept without ids."""
    if keep.all():
        return ids, first
    n = np.diff(first)
    return ids[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(np.where(keep, n, 0))])


def same_bytes(raw: np.ndarray, at: np.ndarray, want: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which rows of (raw, at) have the bytes of the rows of (want, offs)."""
    same = np.diff(at) == np.diff(offs)
    mine, _ = ragged(raw, at[:-1][same], at[1:][same])
    theirs, ends = ragged(want, offs[:-1][same], offs[1:][same])
    wrong = np.concatenate([[0], np.cumsum(mine != theirs)])[np.concatenate([[0], ends])]
    same[same] = wrong[1:] == wrong[:-1]
    return same


# ------------------------------------------------------------------ alignment of a batch
def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) rows of every overlapping pair; tokens are rows in order of their starts."""
    a = pd.DataFrame({"doc": doc_a, "at": start_a, "a": np.arange(len(doc_a))})
    b = pd.DataFrame({"doc": doc_b, "at": start_b, "b": np.arange(len(doc_b))})
    covered = pd.merge_asof(a, b, on="at", by="doc")
    # tokens that start where one of A starts are found in the other direction
    place = np.minimum(np.searchsorted(start_a, start_b), max(len(start_a) - 1, 0))
    later = b[start_a[place] != start_b] if len(start_a) else b
    covers = pd.merge_asof(later, a, on="at", by="doc")
    return tuple(np.concatenate([covered[side].to_numpy(np.int64), covers[side].to_numpy(np.int64)]) for side in ("a", "b"))


class Decimal:
    """Ids written in decimal, each before one of four separators, flat."""

    SEPARATORS = b",|;"

    def __init__(self, size: int):
        strings = [str(i).encode() + s for i in range(size) for s in (b",", b"|", b";", b"")]
        self.data, self.ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])

    def write(self, ids: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = ids * 4 + separator
        return ragged(self.data, self.ends[k], self.ends[k + 1])


def groups(first_a, end_a, ids_a, first_b, end_b, ids_b, decimal: Decimal) -> tuple[np.ndarray, list[str]]:
    """(number of groups, digest of their ids) per document; both sides' ends are offsets in the same bytes."""
    n_rows = len(first_a) - 1
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    doc = row_of(first_a)[np.searchsorted(end_a, cuts)]
    count = np.bincount(doc, minlength=n_rows)
    ids = np.concatenate([ids_a, ids_b])
    cell = np.concatenate([np.searchsorted(cuts, end_a) * 2, np.searchsorted(cuts, end_b) * 2 + 1])  # group, then side
    order = np.argsort(cell, kind="stable")
    ids, cell = ids[order], cell[order]
    separator = np.zeros(len(ids), np.int64)
    new = cell[1:] != cell[:-1]
    separator[:-1][new] = np.where(cell[:-1][new] % 2 == 0, 1, 2)
    of = doc[cell // 2]
    last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
    separator[last] = 3
    raw, ends = decimal.write(ids, separator)
    edge = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n_rows))])
    at = np.concatenate([[0], ends])[edge]
    raw = raw.tobytes()
    return count, [hashlib.sha256(raw[x:y]).hexdigest() if x < y else "" for x, y in zip(at[:-1], at[1:])]


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) of every row of ``docs``.

    ``links`` has each id pair that is linked in the document once: array of struct(a, b, n), n its links.
    """
    files = []
    for path in (a_file, b_file):
        if os.path.getsize(path) > FILE_BYTES:
            raise ValueError(f"tokenizer file over {FILE_BYTES} bytes: {path}")
        with open(path, "rb") as f:
            files.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(files)
    kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])

    def run(batches):
        pair = loaded(*shared.value)
        size_a, size_b = len(pair.a.ends) - 1, len(pair.b.ends) - 1
        for batch in batches:
            for x, y in slices(flat(batch.column(1))[1], SLICE):
                texts = batch.column(1).slice(x, y - x).to_pylist()
                both = [joined_rows(pair.encode_a(texts)), joined_rows(pair.encode_b(texts))]
                want = [b" " + t.encode() if t else b"" for t in texts]
                offs, want = np.cumsum([0, *map(len, want)]), np.frombuffer(b"".join(want), np.uint8)
                ok = np.array([bool(t) for t in texts], bool)
                for (ids, first), side in zip(both, (pair.a, pair.b)):
                    raw, _, at = side.spell(ids, first)
                    ok &= same_bytes(raw, at, want, offs)
                (ids_a, first_a), (ids_b, first_b) = (only_rows(ids, first, ok) for ids, first in both)
                _, end_a, _ = pair.a.spell(ids_a, first_a)
                _, end_b, _ = pair.b.spell(ids_b, first_b)
                doc_a, doc_b = row_of(first_a), row_of(first_b)
                start_a, start_b = np.concatenate([[0], end_a])[:-1], np.concatenate([[0], end_b])[:-1]
                a, b = overlaps(doc_a, start_a, doc_b, start_b)
                n_links = np.bincount(doc_a[a], minlength=y - x)
                n_groups, digests = groups(first_a, end_a, ids_a, first_b, end_b, ids_b, pair.decimal)
                # each id pair of a document once
                cells, times = np.unique((doc_a[a] * size_a + ids_a[a]) * size_b + ids_b[b], return_counts=True)
                rest, pair_b = np.divmod(cells, size_b)
                doc, pair_a = np.divmod(rest, size_a)
                edges = np.searchsorted(doc, np.arange(y - x + 1))
                links = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (pair_a, pair_b, times)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(x, y - x), pa.array(np.diff(first_a)), pa.array(np.diff(first_b)), pa.array(n_groups), pa.array(n_links),
                    pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), links)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return as_text(docs, id_col, text_col).mapInArrow(
        lean(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<a:int,b:int,n:int>>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, docs, best) of (row, a, b, n) links: documents that hold the pair, and whether no pair of its ``a`` has more."""
    counts = stored(links.groupBy("a", "b").agg(F.count("*").alias("docs")), "pairs")
    most = counts.groupBy(F.col("a").alias("m_a")).agg(F.max("docs").alias("most"))
    return counts.join(most, F.col("a") == F.col("m_a")).select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    rows = stored(align(docs, a_file, b_file, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.explode("links").alias("link")).select("row", "link.*")
    counts = stored(pair_counts(links).toDF("c_a", "c_b", "docs", "best"), "pairs")
    small = counts.count() * PAIR_BYTES <= BROADCAST_BYTES
    found = links.join(F.broadcast(counts) if small else counts.hint("merge"), (F.col("a") == F.col("c_a")) & (F.col("b") == F.col("c_b")))
    sums = found.groupBy(F.col("row").alias("s_row")).agg(F.sum(F.when(F.col("best"), F.col("n").cast("long")).otherwise(0)).alias("n_best"),
                                                          F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("links").join(sums, F.col("row") == F.col("s_row"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
