"""Fill-in-middle, tokenizer alignment and source mixing: brute force, round trips and odd rows."""

import collections
import hashlib
import json
import random
import re

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from gridlens.llm import align, fim, mixture
from llm_tables import MEDIUM, SMALL, odd_docs, texts  # noqa: F401

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# ------------------------------------------------------------------ operator 11
def _fim(doc_id, text):
    t = text or ""
    u = UNIT.findall(t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    i, j = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:i], u[i:j], u[j:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, _sha(t), _sha(t)
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return len(u), "spm" if spm else "psm", len(p), len(m), _sha(out), _sha(t)


def _digested(df):
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256),
                     F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256))


def test_fill_in_middle_query(spark, texts):
    got = {r[0]: r[1:] for r in map(tuple, E.queries()["op11_fill_in_middle"](spark, SMALL).collect())}
    assert got == {i: _fim(i, t) for i, t in texts}
    assert {x[1] for x in got.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_odd_rows(spark, odd_docs):
    rng = random.Random(4)
    hard = ["<", "<P", "<P>", "a<S>b", "x<M", "<<SP>>M", ">M><S", "ab" * 70_000, "\U0001F600́é\n" * 50_000, "<S\n>", "", None, "\x00\x7f"]
    hard += ["".join(rng.choice("<>PSMab é\n") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = _digested(fim.fill_in_middle(odd_docs)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((i, *_fim(i, t)) for i, t in rows)
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in _digested(fim.fill_in_middle(df)).collect()} == {i: _fim(i, t) for i, t in enumerate(hard)}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_rank_index_is_exact_and_bounded():
    """Every boundary comes back; residuals keep to the bound; chunks don't show."""
    rng = np.random.default_rng(2)
    steps = [rng.integers(1, 9, 20_000), np.ones(5000, int), rng.integers(1, 2000, 3000), np.tile([1, 1, 300], 900), np.full(40, 10**6)]
    for offsets in [np.cumsum(s) for s in steps] + [np.cumsum(np.concatenate(steps)), np.zeros(1, np.int64)]:
        index = fim.RankIndex()
        index.extend(offsets[:len(offsets) // 3])
        index.extend(offsets[len(offsets) // 3:])
        index.finish()
        assert np.array_equal(index.at(np.arange(len(offsets))), offsets)
        assert not len(index.residuals) or np.abs(index.residuals.astype(int)).max() <= fim.BOUND + 1
    assert len(fim.RankIndex().finish().first) == 0
    words = fim.RankIndex()
    words.extend(np.cumsum(rng.integers(1, 9, 20_000)))
    assert len(words.finish().first) < 20_000 / 100  # segments stand for many boundaries
    raw = np.frombuffer(" ".join("éab 1c" for _ in range(3000)).encode() * 2, np.uint8)
    offs = np.array([0, 0, 7, 7, 5000, len(raw), len(raw)])
    whole, first = fim.index_units(raw, offs)
    parts, first2 = fim.index_units(raw, offs, chunk=64)
    assert np.array_equal(first, first2) and np.array_equal(whole.at(np.arange(whole.n)), parts.at(np.arange(parts.n)))


# ------------------------------------------------------------------ operator 12
@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(align.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.B_FILE)
    letter = align.byte_level()
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids, lambda t: b.encode(t),
            lambda i: bytes(letter[c] for c in a.id_to_token(i)),
            lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())


def _aligned(rows, tokenizers):
    """Plain alignment of (id, text) rows: every pair of tokens is compared by its ranges."""
    enc_a, enc_b, bytes_a, bytes_b = tokenizers
    out, pairs = [], []
    for i, t in rows:
        a, b = (enc_a(t), enc_b(t)) if t else ([], [])
        want = (" " + (t or "")).encode()
        if not t or b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
            a, b = [], []
        ends = [np.cumsum([len(f(x)) for x in ids], dtype=int).tolist() for ids, f in ((a, bytes_a), (b, bytes_b))]
        starts = [[0, *e[:-1]] for e in ends]
        links, j = collections.Counter(), 0
        for x in range(len(a)):
            while j < len(b) and ends[1][j] <= starts[0][x]:
                j += 1
            k = j
            while k < len(b) and starts[1][k] < ends[0][x]:
                links[a[x], b[k]] += 1
                k += 1
        cuts, groups = sorted(set(ends[0]) & set(ends[1])), []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, es) if lo < e <= hi) for ids, es in ((a, ends[0]), (b, ends[1]))))
        out.append((i, len(a), len(b), len(groups), _sha(";".join(groups)) if groups else ""))
        pairs.append(links)
    count = collections.Counter(p for links in pairs for p in links)
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return collections.Counter((*o[:4], sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[0]]),
                                sum(n * count[p] for p, n in links.items()), o[4]) for o, links in zip(out, pairs))


def _got(df):
    return collections.Counter(map(tuple, df.collect()))


def test_alignment_query(spark, texts, tokenizers):
    small = texts[:60]
    df = spark.createDataFrame(small, "doc_id long, text string").repartition(5)
    assert _got(align.align_corpus(df)) == _aligned(small, tokenizers)
    got = E.queries()["op12_tokenizer_alignment"](spark, SMALL)
    assert {r.doc_id: (r.n_a, r.n_b) for r in got.collect()} == {i: (len(tokenizers[0](t)), len(tokenizers[1](t))) for i, t in texts}


def test_alignment_odd_rows(spark, odd_docs, tokenizers, monkeypatch):
    rng = random.Random(8)
    hard = [" ", "  two", "tab\tx\n\n y ", "<|endoftext|> </s> <s> <unk> <0x41>", "a▁b", "▁", "é😀​́", "x" * 5000, "\x00", "\r\n", "日本語テキスト", "a" + " " * 300 + "b", "repeated", "repeated"]
    hard += ["".join(rng.choice("ab cé日😀\n 1.<>s/|") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    rows = [(r.doc_id, r.text if r.doc_id != 6 else " ".join(r.text.split()[:1500])) for r in odd_docs.collect()]
    rows += [(100 + i, t) for i, t in enumerate(hard)]
    df = spark.createDataFrame([(*r, "c", "c", 1) for r in rows], "doc_id long, text string, a string, links string, row long")
    want = _aligned(rows, tokenizers)
    assert _got(align.align_corpus(df)) == want
    monkeypatch.setattr(align, "BROADCAST_BYTES", 0)  # the same by shuffle
    assert _got(align.align_corpus(df)) == want
    assert align.align_corpus(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert _got(align.align_corpus(empty)) == collections.Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_alignment_counted_pairs_are_not_broadcast_beyond_the_bound(spark, texts, monkeypatch):
    monkeypatch.setattr(align, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = align.align_corpus(spark.createDataFrame(texts[:5], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin [a#" in plan


# ------------------------------------------------------------------ operator 13
def _targets(sizes):
    """Targets by rounds of sharing out the excess, as the contract states them."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in fixed)
        heavy = sum(weight[s] for s in names if s not in fixed)
        out = {s: 3 * sizes[s] if s in fixed else rest * weight[s] / heavy for s in names}
        over = {s for s in names if s not in fixed and out[s] > 3 * sizes[s]}
        if not over:
            return out
        fixed |= over


def _check(rows, docs):
    """Rows of mix_sources against sizes, targets and bounds."""
    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    want = _targets(dict(sizes)) if any(sizes.values()) else {s: 0.0 for s in sizes}
    assert collections.Counter((r.doc_id, r.source, r.size) for r in rows) == collections.Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.size * r.passes + sum(x["stop"] - x["first"] for x in r.spans or [])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 1e-3 * want[s]), (s, taken[s], want[s])
    return taken


def test_mixture_of_the_small_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixture.mix_sources(df).collect()
    _check(rows, docs)
    again = mixture.mix_sources(df.repartition(7, F.rand(3))).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixture_sources_that_stop(spark, odd_docs):
    """A tiny heavy source stops at three times its size; a hot one, a null one, and one without words."""
    docs = [(1, "a b c", "a0"), (2, "", "a0"), (3, None, "zero"), (None, "x y", None), (None, "x y", None), (7, "q", "é")]
    docs += [(100 + i, " ".join(["w"] * (i % 50)), "hot") for i in range(900)] + [(5000 + i, "word " * 31, "next") for i in range(60)]
    for blocks in (100_000, 20):
        rows = mixture.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string"), mixture.Mix(blocks=blocks)).collect()
        if blocks == 100_000:
            taken = _check(rows, docs)
            assert taken["a0"] == 9 and taken["zero"] == 0
        assert all(0 <= r.taken <= 3 * r.size for r in rows)
    rows = mixture.mix_sources(odd_docs).collect()
    _check(rows, [(r.doc_id, r.text, r.source) for r in odd_docs.collect()])
    assert mixture.mix_sources(odd_docs.limit(0)).count() == 0
    none = mixture.mix_sources(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in none) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_apportionment_is_by_highest_quotients(spark):
    """Against ranking every quotient, few and many seats, with ties."""
    rng = random.Random(6)
    rows, want = [], {}
    for g in range(30):
        votes = [rng.choice([1, 2, 3, 5, 8, rng.randint(1, 10_000)]) for _ in range(rng.randint(1, 25))]
        seats = rng.choice([0, 1, 2, len(votes), rng.randint(1, 3000)])
        quotients = sorted(((-v / (2 * s - 1), p) for p, v in enumerate(votes) for s in range(1, seats + 1)))[:seats]
        won = collections.Counter(p for _, p in quotients)
        rows += [(g, p, v, seats) for p, v in enumerate(votes)]
        want |= {(g, p): won[p] for p in range(len(votes))}
    got = mixture.apportion(spark.createDataFrame(rows, "g int, p int, v long, seats long"), "g", "p", "v", "seats")
    assert {(r.g, r.p): r.won for r in got.collect()} == want


def test_mixture_runs_without_python(spark):
    df = mixture.mix_sources(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", df._jdf.queryExecution().executedPlan().toString())


def test_oracles_of_token_operators(spark):
    """The registered SQL gives the queries' rows."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    for name in ("op11_fill_in_middle", "op13_source_mixture"):
        df = E.queries()[name](spark, SMALL)
        cur = con.execute(E.oracle_sql()[name])
        order = [[d[0] for d in cur.description].index(c) for c in df.columns]
        assert collections.Counter(map(tuple, df.collect())) == collections.Counter(tuple(r[i] for i in order) for r in cur.fetchall())


def test_byte_level_letters():
    vocab = json.load(open(align.A_FILE))["model"]["vocab"]
    assert set("".join(k for k in vocab if k != "<|endoftext|>")) <= set(align.byte_level())


def test_an_encoder_remembers_two_hundred_thousand_words_between_slices():
    """Words of a large vocabulary come back in later slices; segmenting them anew was most of the work."""
    from gridlens.llm import pieces
    encoder = pieces.Encoder(pieces.load_model())
    encoder.encode([" ".join(f"w{i}" for i in range(150_000))])
    encoder.encode(["again w7"])
    assert len(encoder.code) > 150_000
