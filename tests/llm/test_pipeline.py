"""The corpus pipeline, stage by stage against brute force on a small documents table."""

import sentencepiece

import corpus_pipeline as P
from gridlens.llm import pieces
from llm_tables import SMALL, odd_docs  # noqa: F401
from test_text_operators import _components, _repeats


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = P.stored(stage(spark, docs, SMALL), name)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name] = (docs.collect(), out.collect())
        docs = out

    before, after = kept["language_id"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}  # prose in known languages stays
    before, after = kept["near_duplicates"]
    names = _components([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in names.items() if i == c)
    before, after = kept["suffix_dedup"]
    want = {d: (n, gone) for d, n, gone, _, _ in _repeats([(r.doc_id, r.text) for r in before], P.REPEATED_BYTES)}
    left = {r.doc_id: r for r in after}
    for r in before:
        n, gone = want[r.doc_id]
        if r.doc_id in left:
            assert n - gone - 6 <= len(left[r.doc_id].text.encode()) <= n - gone and left[r.doc_id].n_chars == len(left[r.doc_id].text)
        else:
            assert gone
    before, after = kept["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before if any(i in r.text for i in items)}
    assert not leaked & {r.doc_id for r in after} and len(before) - len(after) <= 2 * len(leaked) + 2
    before, after = kept["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r.round_trip and r.piece_ids == library.encode(texts[r.doc_id], num_threads=1) and r.n_pieces == len(r.piece_ids)


def test_odd_rows_pass_all_stages(spark, odd_docs):  # noqa: F811
    docs = odd_docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as int) AS n_chars")
    for rows in (docs, docs.limit(0)):
        n = rows.count()
        for name, stage in P.STAGES:
            rows = P.stored(stage(spark, rows, SMALL), name)
        assert rows.count() <= n
        if n:
            assert rows.filter("doc_id = 6").count() == 1  # one of two repeated rows


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")


def test_rows_without_an_id_or_with_a_shared_one_are_decided_each_by_its_own_text(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    clean = [f"clean text number {w} stands for itself" for w in ("one", "two", "three")]
    rows = [(None, clean[0]), (None, f"before {item} after"), (None, clean[1]), (7, clean[2]), (7, item)]
    kept = P.decontamination(spark, _docs(spark, rows), SMALL).collect()
    assert sorted(r.text for r in kept) == sorted(clean)
    # rejected rows have no letters
    kept = P.language_id(spark, _docs(spark, [(None, clean[0]), (None, "12 34"), (None, "!!"), (7, clean[1]), (7, "56")]), SMALL).collect()
    assert sorted(r.text for r in kept) == sorted(clean[:2])


def test_near_duplicates_without_an_id_or_with_a_shared_one(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (5, text("b")), (3, text("b") + " more"),
            (7, text("c")), (7, text("d")), (8, text("e")), (8, text("e")), (9, ""), (9, ""), (10, ""), (1, None)]
    kept = P.near_duplicates(spark, _docs(spark, rows), SMALL).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted((str(i), t) for i, t in [
        (None, text("a")), (3, text("b") + " more"), (7, text("c")), (7, text("d")), (8, text("e")), (9, ""), (10, ""), (1, "")])
    docs = _docs(spark, [(None, text("a")), (None, text("a"))])
    for name, stage in P.STAGES[:4]:
        docs = P.stored(stage(spark, docs, SMALL), name)
    assert [r.text for r in docs.collect()] == [text("a")]  # the last copy stays


def test_entry_lists_pipeline_and_operators():
    import __spark_entry__ as E
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {k.split("_")[0] if k.startswith("op") else k for k in E.queries()}
