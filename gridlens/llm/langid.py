"""Language identification by Bayesian evidence fusion (operator 4).

Evidence per document, all as log-probabilities over the same languages plus ``und`` (none of them):

- text: hashed 4-byte grams of the whole text (A-Z lower-cased, other ASCII characters one space)
  under one multinomial per language; the mean over all grams counts for at most ``SATURATION``
  grams, as grams of one text aren't independent; ``und`` has all grams alike;
- declared language (markup or metadata): how often texts of each language carry that declaration,
  counted over all documents by grouped aggregation;
- address: a prior per host, smoothed towards its address suffix, which is smoothed towards all
  documents.  Counts come from the texts' own best languages, grouped over all documents; a
  document's own vote is taken out of its prior.

A document is kept if it has letters and its best language isn't ``und``.

The gram model is fitted on at most ``PER_LANGUAGE`` labelled rows of each language (chosen by a
hash of the id, expected number); everything else covers all rows.

Cases: null and empty texts, and texts without letters, have no text evidence, get the language
that the other evidence gives, and are not kept; null hosts, suffixes and declarations give no
evidence; equal posteriors go to the first language in order; repeated rows get equal results;
an empty table gives an empty result; a table without labels knows only ``und``; other columns are
not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, row_of, stored, text_slices

PER_LANGUAGE, BUCKETS, SATURATION, SMOOTHING = 1000, 1 << 16, 200.0, 0.5
#: Pseudo-counts of the address hierarchy and of declarations, and the prior of ``und``.
HOST_WEIGHT, DECLARED_WEIGHT, UND_PRIOR = 5.0, 2.0, 0.01
#: At most so many languages; more would not be a proven size to send to every task.
MOST_LANGUAGES = 256
UND = "und"

_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each gram, row offsets of grams, letters per row) of a slice of texts."""
    c = _CLASS[raw]
    blank = c == 0x20
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    edges = offs[:-1][offs[:-1] < len(c)]
    keep[edges] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    letters_before = np.concatenate([[0], np.cumsum(~blank)])
    c, offs2 = c[keep].astype(np.uint32), kept_before[offs]
    letters = letters_before[offs[1:]] - letters_before[offs[:-1]]
    n = np.maximum(np.diff(offs2) - 3, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) + np.repeat(offs2[:-1] - first[:-1], n)
    g = (c[at] << np.uint32(24)) | (c[at + 1] << np.uint32(16)) | (c[at + 2] << np.uint32(8)) | c[at + 3] if len(at) else np.zeros(0, np.uint32)
    return (g * np.uint32(0x9E3779B1)) >> np.uint32(16), first, letters


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE):
    """(languages, table of log-probabilities [bucket, language + und]) from a bounded sample of labelled rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), tag(F.col(label_col)).alias("label")).filter("label is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LANGUAGES).collect()}
    languages = sorted(counts)
    table = np.full((BUCKETS, len(languages) + 1), -math.log(BUCKETS))
    if not languages:
        return languages, table
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / (1 << 20)
    sample = rows.filter(chance < share[F.col("label")])

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        index = {k: i for i, k in enumerate(languages)}
        for batch in batches:
            code = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b, raw, offs in text_slices(batch.column(0)):
                g, first, _ = grams(raw, offs)
                np.add.at(total, (code[a:b][row_of(first)], g), 1)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], names=["l", "g", "n"])

    cells = sample.select("text", "label").mapInArrow(lean(count), "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    found = cells.toPandas()  # at most languages x buckets cells
    n = np.zeros((BUCKETS, len(languages)))
    n[found.g.to_numpy(), found.l.to_numpy()] = found.n.to_numpy()
    table[:, :-1] = np.log((n + SMOOTHING) / (n.sum(0) + SMOOTHING * BUCKETS))
    return languages, table


def tag(declared: Column) -> Column:
    """Primary language tag in lower case, null if it isn't one."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(declared.cast("string")), r"^([A-Za-z]{2,3})(?![A-Za-z])", 1)), F.lit(""))


def text_scores(rows: DataFrame, model) -> DataFrame:
    """Rows (doc_id, host, suffix, declared, text) with their text evidence instead of the text."""
    languages, log_p = model
    shared = rows.sparkSession.sparkContext.broadcast(log_p.astype(np.float32))

    def run(batches):
        log_p = shared.value
        for batch in batches:
            for a, b, raw, offs in text_slices(batch.column(4)):
                g, first, letters = grams(raw, offs)
                n = np.diff(first)
                total = np.zeros((b - a, log_p.shape[1]))
                some = np.flatnonzero(n)
                if len(some):
                    total[some] = np.add.reduceat(log_p[g], first[:-1][some], axis=0, dtype=np.float64)
                weight = np.zeros(b - a)
                weight[some] = 1.0 / (1.0 + n[some] / SATURATION)
                scores = total * weight[:, None]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(4)), pa.array(n), pa.array(letters),
                                                  pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * log_p.shape[1], pa.int32()), pa.array(scores.ravel()))],
                                                 names=["doc_id", "host", "suffix", "declared", "n_grams", "n_letters", "scores"])

    return rows.select("doc_id", "host", "suffix", "declared", "text").mapInArrow(
        lean(run), "doc_id long, host string, suffix string, declared string, n_grams long, n_letters long, scores array<double>")


def _best(scores: Column) -> Column:
    """0-based place of the largest value (the first of equals)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def identify(docs: DataFrame, model, id_col: str = "doc_id", text: Column | str = "text", declared: Column | None = None,
             host: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """(doc_id, language, posterior, text_language, declared, n_grams, kept) for every row of ``docs``."""
    languages = model[0]
    names = F.array(*[F.lit(x) for x in [*languages, UND]])
    none, size = F.lit(None).cast("string"), len(languages) + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (none if host is None else host.cast("string")).alias("host"),
                       (none if suffix is None else suffix.cast("string")).alias("suffix"), (none if declared is None else tag(declared)).alias("declared"),
                       F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).alias("text"))
    rows = stored(text_scores(rows, model).withColumn("own", F.when(F.col("n_grams") > 0, _best(F.col("scores")))), "langid")

    # counts of the texts' own languages over all documents: partly aggregated before each shuffle
    votes = [F.sum((F.col("own") == i).cast("long")).alias(f"v{i}") for i in range(size)]
    again = [F.sum(f"v{i}").alias(f"v{i}") for i in range(size)]
    array = F.array(*[F.col(f"v{i}") for i in range(size)])
    hosts = stored(rows.filter("own is not null").groupBy("suffix", "host", "declared").agg(*votes), "langid")
    overall = hosts.agg(*again).first()
    total = [float(overall[i] or 0) for i in range(size)]
    base = [(v + 1) / (sum(total) + size) for v in total]
    base[-1] = min(base[-1], UND_PRIOR)
    base_array = F.array(*[F.lit(x / sum(base)) for x in base])
    by_host = hosts.filter("host is not null").groupBy(F.col("host").alias("h_host")).agg(*again).select("h_host", array.alias("h_votes"))
    by_suffix = hosts.filter("suffix is not null").groupBy(F.col("suffix").alias("s_suffix")).agg(*again).select("s_suffix", array.alias("s_votes"))
    by_declared = hosts.filter("declared is not null").groupBy(F.col("declared").alias("d_declared")).agg(*again).select("d_declared", array.alias("d_votes"))

    zero = F.array(*[F.lit(0).cast("long")] * size)
    own = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce((i == F.col("own")).cast("long"), F.lit(0).cast("long")))
    minus = lambda votes, has: F.zip_with(F.coalesce(votes, zero), own, lambda a, b: a - F.when(has.isNotNull(), b).otherwise(0))
    summed = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    smooth = lambda votes, parent, weight: F.zip_with(votes, parent, lambda a, b: (a + weight * b) / (summed(votes) + weight))
    joined = (rows.join(by_suffix, rows.suffix == by_suffix.s_suffix, "left").join(by_host, rows.host == by_host.h_host, "left")
              .join(by_declared, rows.declared == by_declared.d_declared, "left"))
    joined = joined.withColumns({"s_votes": minus(F.col("s_votes"), F.col("suffix")), "h_votes": minus(F.col("h_votes"), F.col("host")),
                                 "d_votes": minus(F.col("d_votes"), F.col("declared"))})
    joined = joined.withColumn("s_prior", smooth(F.col("s_votes"), base_array, HOST_WEIGHT))
    joined = joined.withColumn("prior", smooth(F.col("h_votes"), F.col("s_prior"), HOST_WEIGHT))
    # P(declaration | language) up to a factor: P(language | declaration) / P(language)
    said = F.zip_with(smooth(F.col("d_votes"), base_array, DECLARED_WEIGHT), base_array, lambda a, b: F.log(a / b))
    joined = joined.withColumn("said", F.when(F.col("declared").isNotNull(), said).otherwise(F.transform(zero, lambda x: x.cast("double"))))
    fused = F.zip_with(F.zip_with("scores", F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b), F.col("said"), lambda a, b: a + b)
    joined = joined.withColumn("fused", fused).withColumn("best", _best(F.col("fused")))
    norm = F.aggregate(F.transform("fused", lambda x: F.exp(x - F.array_max("fused"))), F.lit(0.0), lambda a, b: a + b)
    return joined.select("doc_id", F.get(names, F.col("best")).alias("language"), (1 / norm).alias("posterior"),
                         F.get(names, F.col("own")).alias("text_language"), "declared", "n_grams",
                         ((F.col("n_letters") > 0) & (F.col("best") < len(languages))).alias("kept"))


def page_text(html: Column) -> Column:
    """Text of a page, for its letters only: scripts, styles and tags become spaces."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def declared_in(html: Column) -> Column:
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1)
