"""Training-data pipeline over the ``documents`` table: five stages, each one operator of ``gridlens.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents``; the last returns token ids.  A stage that changes texts sets ``n_chars``
anew.  Decisions are joined on a key of the row's content, never on ``doc_id``: ids may be missing
or stand on several texts.  Only rows with equal content share a key, and an operator decides them
alike, so the key needs no place in the stage tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import decontaminate, langid, minhash, pieces, suffix
from gridlens.llm.common import prepare, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates in the pipeline: five words, a similarity of 0.8; recall at the limit is 0.9998.
NEAR = minhash.Near(words=5, num=80, den=100, r=4, m=18)
#: Bytes of a repeated passage that goes: under the length of 50 short words.
REPEATED_BYTES = 200
#: Bytes of decided keys up to which they are sent to all executors; beyond, documents are joined by shuffle.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 32


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with ``row_key``: 64 bits of ``doc_id``, ``text`` and the other columns that an operator looks at; nulls count."""
    cells = [x for c in ("doc_id", "text", *columns) for x in (F.col(c), F.col(c).isNull())]
    return docs.select(*COLUMNS, F.xxhash64(*cells).alias("row_key"))


def _by_key(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """``docs`` with keys joined with stored (f_key, ..) rows of distinct keys."""
    small = decided.count() * ROW_BYTES <= BROADCAST_BYTES
    return docs.join(F.broadcast(decided) if small else decided, docs.row_key == decided.f_key, how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the identified one. Rejected documents go."""
    prepare(spark)
    docs = _keyed(docs, "lang", "source")
    found = langid.identify(docs, langid.fit(docs, "row_key"), "row_key", declared=F.col("lang"), host=F.col("source"))
    decided = stored(found.filter("kept").groupBy(F.col("doc_id").alias("f_key")).agg(F.min("language").alias("language")), "decided")
    return _by_key(docs, decided, "inner").select("doc_id", "text", F.col("language").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id (rows without an id come last).

    Rows equal in id and text are one document.
    """
    prepare(spark)
    docs = _keyed(docs)
    found = minhash.near_duplicates(docs, NEAR, "row_key").groupBy(F.col("doc_id").alias("f_key")).agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    ids = docs.groupBy("row_key").agg(F.min("doc_id").alias("doc_id"))
    found = stored(found.join(ids, F.col("f_key") == F.col("row_key")).select("f_key", "component", "n", "doc_id"), "near")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "f_key")).alias("first"))
    gone = stored(found.select("f_key").join(first.select(F.col("first.f_key").alias("k_key")), F.col("f_key") == F.col("k_key"), "left_anti"), "decided")
    left = _by_key(docs, gone, "left_anti")
    again = stored(found.filter("n > 1").select("f_key"), "decided")
    if again.isEmpty():
        return left.select(*COLUMNS)
    one = _by_key(left, again, "left_semi").groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("one")).select("one.*")
    return _by_key(left, again, "left_anti").select(*COLUMNS).union(one)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere as well; texts with nothing but space left go."""
    prepare(spark)
    out = suffix.remove_repeats(docs, REPEATED_BYTES, keep=("lang", "source"), as_string=True)
    left = out.filter((F.col("n_removed") == 0) | F.col("rest").rlike(r"\S"))
    return left.select("doc_id", F.col("rest").alias("text"), "lang", "source", F.length("rest").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    docs = _keyed(docs)
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), "row_key")
    gone = stored(leaks.select(F.col("doc_id").alias("f_key")).distinct(), "decided")
    return _by_key(docs, gone, "left_anti").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text back."""
    prepare(spark)
    out = pieces.round_trip(docs, keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The stages' hashing, sorting and segmentation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's result over ``documents``; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
