"""SentencePiece encoding and decoding by shared-prefix Viterbi (operator 10).

A normalised text is a row of marked words (``▁word``): no piece continues past a word's end, so
words are segmented one by one.  The distinct marked words of a slice of texts are sorted, which
is a depth-first walk of their trie: a word shares with the one before it the forward scores of their
common prefix and only its remaining characters are scored.

Both kinds of model are read from the model file:

- unigram: forward score of a prefix = best sum of piece scores (plain Viterbi);
- BPE: the score of a step is 0 if the merge order lets the piece follow the prefix's last piece,
  else minus infinity.  Exactly one segmentation has a finite score, and it is the one that
  merging gives, so ids equal those of the sentencepiece library.  (The library's scores of a BPE
  model are merge ranks; their sum has no meaning.)

Characters without a piece become byte pieces (or the unknown piece if the model has no bytes).

Cases: a null text counts as empty; an empty text has no pieces; ``▁`` itself reads as a space, as
in the library; repeated rows are encoded alike; empty tables give empty results; only the id and
text columns are looked at.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, lean, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Largest model file that is broadcast, and distinct words (and pairs of pieces) a worker remembers between slices.
MODEL_BYTES, REMEMBERED = 64 << 20, 300_000
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


@dataclass
class Model:
    """Pieces of a model file, and what the forward pass needs of them."""
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool
    prefix: bool
    trim: bool = False
    ids: dict[str, int] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    halves: dict[int, tuple[int, int]] = field(default_factory=dict)
    unknown: int = 0
    usable: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (_NORMAL, _USER)}
        self.byte_ids = [i for i, k in enumerate(self.kinds) if k == _BYTE]
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == _UNKNOWN), 0)
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.usable = dict(self.ids)
        if not self.unigram:
            for p, i in self.ids.items():
                if len(p) > 1:
                    whole, half = merge(self, p)
                    if whole != [i]:
                        del self.usable[p]  # merging never makes this piece
                    else:
                        self.halves[i] = half


def load_model(path: str = MODEL) -> Model:
    """Read a model file (on the driver; its size is bounded)."""
    import os
    from sentencepiece import sentencepiece_model_pb2 as proto
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"model file over {MODEL_BYTES} bytes: {path}")
    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.trainer_spec.model_type not in (1, 2) or m.normalizer_spec.name != "identity":
        raise ValueError("only unigram and BPE models with identity normalisation")
    return Model([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces],
                 m.trainer_spec.model_type == 1, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces)


def merge(model: Model, word: str) -> tuple[list[int | str], tuple[int, int] | None]:
    """Pieces of ``word`` by repeated best merges, and the two halves of the last merge."""
    n = len(word)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    queue: list[tuple[float, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (p := model.ids.get(word[i:end[j]])) is not None:
            heapq.heappush(queue, (-model.scores[p], i, end[i], end[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    last = None
    while queue:
        _, i, middle, stop = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or end[i] != middle or j >= n or end[j] != stop:
            continue
        last = (model.ids.get(word[i:middle], -1), model.ids.get(word[middle:stop], -1))
        end[i], after[i], alive[j] = stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
            offer(i, after[i])
        offer(before[i], i)
    return [model.ids.get(word[i:end[i]], word[i:end[i]]) for i in range(n) if alive[i]], last


class Encoder:
    """Segments sorted distinct words; keeps what it found as flat arrays."""

    def __init__(self, model: Model):
        self.m, self.follows = model, {}
        self.lengths = [len(p) for p in model.pieces]
        finder = ahocorasick.Automaton()
        for p, i in model.usable.items():
            finder.add_word(p, i)
        finder.make_automaton()
        self.matches = finder.iter
        self.code: dict[str, int] = {}
        self.flat, self.offs = array("i"), array("q", [0])

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging ``a`` + ``b`` leaves both: no pair of their edge pieces merges while it exists.

        ``x`` runs up the right edge of ``a`` and ``y`` up the left edge of ``b``; each lives until
        the merge that takes it in.  On equal scores the merge further left comes first.
        """
        known = self.follows.get((a, b))
        if known is None:
            m, worst = self.m, float("-inf")
            right, left = [(a, worst)], [(b, worst)]
            while right[-1][0] in m.halves:
                right.append((m.halves[right[-1][0]][1], m.scores[right[-1][0]]))
            while left[-1][0] in m.halves:
                left.append((m.halves[left[-1][0]][0], m.scores[left[-1][0]]))
            known, i, j = True, len(right) - 1, len(left) - 1
            while True:
                (x, until_x), (y, until_y) = right[i], left[j]
                joined = m.ids.get(m.pieces[x] + m.pieces[y])
                if joined is not None and m.scores[joined] > until_x and m.scores[joined] >= until_y:
                    known = False
                    break
                if i == j == 0:
                    break
                if j == 0 or (i > 0 and until_x >= until_y):
                    i -= 1
                else:
                    j -= 1
            if len(self.follows) > REMEMBERED:
                self.follows.clear()
            self.follows[a, b] = known
        return known

    def fallback(self, c: str) -> list[int]:
        return [self.m.byte_ids[x] for x in c.encode("utf-8", "surrogatepass")] if self.m.byte_ids else [self.m.unknown]

    def add(self, words) -> None:
        """Segment the words not known yet, in sorted order, reusing forward scores of common prefixes."""
        m, follows, lengths = self.m, self.follows, self.lengths
        last: list[int | None] = [None]   # last piece of the best segmentation of each prefix; None: a lone character
        best: list[float] = [0.0]         # its score (unigram)
        previous = ""
        for word in sorted(set(words) - self.code.keys()):
            if not m.unigram and word.startswith(MARK + MARK):
                self.keep(word, [x for p in merge(m, word)[0] for x in ([p] if isinstance(p, int) else self.fallback(p))])
                continue
            n, same, most = len(word), 0, min(len(previous), len(word))
            while same < most and previous[same] == word[same]:
                same += 1
            last[same + 1:] = [None] * (n - same)
            if m.unigram:
                best[same + 1:] = [float("-inf")] * (n - same)
                self.best_scores(word, same, last, best)
            else:
                for e, p in self.matches(word):
                    if e < same or last[e + 1] is not None:
                        continue  # scored already: with the previous word, or by the one piece that may stand here
                    before = last[e + 1 - lengths[p]]
                    if before is not None:
                        ok = follows.get((before, p))
                        if not (self.may_follow(before, p) if ok is None else ok):
                            continue
                    last[e + 1] = p
            out, i = [], n
            while i > 0:
                p = last[i]
                if p is None:
                    out.extend(reversed(self.fallback(word[i - 1])))
                    i -= 1
                else:
                    out.append(p)
                    i -= lengths[p]
            out.reverse()
            self.keep(word, out)
            previous = word

    def best_scores(self, word: str, same: int, last: list, best: list) -> None:
        """Forward scores of the prefixes of ``word`` longer than ``same`` (unigram)."""
        ends: dict[int, list[int]] = {}
        for e, p in self.matches(word):
            if e >= same:
                ends.setdefault(e + 1, []).append(p)
        for i in range(same + 1, len(word) + 1):
            lone = True
            for p in ends.get(i, ()):
                lone = lone and self.lengths[p] > 1
                if (s := best[i - self.lengths[p]] + self.m.scores[p]) > best[i]:
                    best[i], last[i] = s, p
            if lone and (s := best[i - 1] + self.m.worst) > best[i]:
                best[i], last[i] = s, None

    def keep(self, word: str, ids: list[int]) -> None:
        self.code[word] = len(self.offs) - 1
        self.flat.extend(ids)
        self.offs.append(len(self.flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets) of a slice of texts."""
        if len(self.code) > REMEMBERED:
            self.code, self.flat, self.offs = {}, array("i"), array("q", [0])
        units = [_UNITS.findall((MARK if self.m.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        self.add({w for u in units for w in u})
        codes = np.fromiter((self.code[w] for u in units for w in u), np.int64)
        offs, ids = np.frombuffer(self.offs, np.int64), np.frombuffer(self.flat, np.int32)
        out, ends = ragged(ids, offs[codes], offs[codes + 1])
        rows = np.cumsum([0, *map(len, units)])
        return out, np.concatenate([[0], ends])[rows]


def ragged(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated values[start:end] of each pair, and the running ends."""
    n = ends - starts
    stop = np.cumsum(n)
    total = int(stop[-1]) if len(stop) else 0
    return values[np.arange(total) + np.repeat(starts - (stop - n), n)], stop


class Decoder:
    """Texts of id rows, from flat piece strings."""

    def __init__(self, model: Model):
        strings = [p.replace(MARK, " ").encode() if k in (_NORMAL, _USER) else bytes([int(p[3:5], 16)]) if k == _BYTE
                   else " ⁇ ".encode() if k == _UNKNOWN else b"" for p, k in zip(model.pieces, model.kinds)]
        self.data, self.ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
        self.is_byte, self.prefix = np.array([k == _BYTE for k in model.kinds]), model.prefix

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(texts, number of byte pieces) of id rows."""
        raw, stop = ragged(self.data, self.ends[ids], self.ends[ids + 1])
        at = np.concatenate([[0], stop])[offs]
        raw = raw.tobytes()
        bytes_before = np.concatenate([[0], np.cumsum(self.is_byte[ids])])
        texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:])]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts], bytes_before[offs[1:]] - bytes_before[offs[:-1]]


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(doc_id, text, kept_0, ..) rows, and the schema of the kept columns."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    return rows, [f"kept_{i} {rows.schema[f'kept_{i}'].dataType.simpleString()}" for i in range(len(keep))]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the ``keep`` columns, piece_ids array<int>) of every row of ``docs``."""
    return _encoded(docs, id_col, text_col, model_path, keep, False)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """``encode`` with what decoding the ids gives: n_byte_pieces, n_chars (of the decoded text), round_trip (it equals the input).

    Both run in one Python worker, so ids don't travel and a task has one worker, not two.
    """
    return _encoded(docs, id_col, text_col, model_path, keep, True)


def _encoded(docs: DataFrame, id_col: str, text_col: str, model_path: str, keep: tuple[str, ...], back: bool) -> DataFrame:
    rows, extra = _rows(docs, id_col, text_col, keep)
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    fields = ["doc_id long", *extra, "piece_ids array<int>"] + ["n_byte_pieces long", "n_chars long", "round_trip boolean"] * back
    names = [f.split()[0] for f in fields]

    def run(batches):
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            for a, b in slices(flat(batch.column(1))[1]):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                ids, offs = encoder.encode(texts)
                columns = [batch.column(0).slice(a, b - a), *(batch.column(2 + i).slice(a, b - a) for i in range(len(extra))),
                           pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))]
                if back:
                    decoded, n_bytes = decoder.decode(ids, offs)
                    columns += [pa.array(n_bytes, pa.int64()), pa.array(map(len, decoded), pa.int64()), pa.array([x == y for x, y in zip(decoded, texts)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(lean(run), ", ".join(fields)).withColumnsRenamed({f"kept_{i}": c for i, c in enumerate(keep)})


def decode(encoded: DataFrame, model_path: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the ``keep`` columns, n_pieces, n_byte_pieces, text) read back from ``piece_ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model_path))
    schema = ", ".join(["doc_id long", *(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep),
                        "n_pieces long", "n_byte_pieces long", "text string"])

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            column = batch.column(1 + len(keep))
            all_offs = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy()
            for a, b in slices(all_offs - all_offs[0], 1 << 20):
                offs = all_offs[a:b + 1] - all_offs[a]
                texts, n_bytes = decoder.decode(values[all_offs[a]:all_offs[b]], offs)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(a, b - a) for i in range(1 + len(keep))),
                    pa.array(np.diff(offs)), pa.array(n_bytes, pa.int64()), pa.array(texts, pa.string()),
                ], names=["doc_id", *keep, "n_pieces", "n_byte_pieces", "text"])

    return encoded.select("doc_id", *keep, "piece_ids").mapInArrow(lean(run), schema)
