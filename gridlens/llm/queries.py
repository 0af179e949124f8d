"""The registered queries of this subpackage: one thin query per operator, and the pipeline."""

from __future__ import annotations

from .common import shared_dir, table

OP8 = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Rules of the op1 query, as (verdict, host/path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_url_filters(spark, sf_dir):
    from . import urls
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)


def op2_chat_formatting(spark, sf_dir):
    """Every conversation and conversation -1, whose texts look like the template's own marks."""
    from . import chat
    marks = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_chats(rows))


def op3_decontamination(spark, sf_dir):
    from . import decontaminate
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark, sf_dir):
    """Every document; its metadata declares a language, its source stands for the host."""
    from pyspark.sql import functions as F
    from . import langid
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs), declared=F.col("lang"), host=F.col("source"))


def language_id_pages(spark, sf_dir):
    """Every page: markup language, address suffix and host beside the text."""
    from pyspark.sql import functions as F
    from . import langid, urls
    pages = table(spark, sf_dir, "pages")
    host = urls.parse(F.col("url"))[0]
    return langid.identify(pages, langid.fit(table(spark, sf_dir, "documents")), "page_id", langid.page_text(F.col("html")),
                           langid.declared_in(F.col("html")), host, F.substring_index(host, ".", -1)).withColumnRenamed("doc_id", "page_id")


def op5_minhash(spark, sf_dir):
    from . import minhash
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    """``text`` is what remains of the document; bytes of a character cut in two show as U+FFFD there (not in the digest)."""
    from pyspark.sql import functions as F
    from . import suffix
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("rest").cast("string")).alias("text"))


def op7_compression_bands(spark, sf_dir):
    from .compression import compression_bands
    return compression_bands(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    """Write every page as a WARC record below the shared folder, then read the archives back."""
    from pyspark.sql import functions as F
    from . import warc
    folder = shared_dir(spark, "warc")
    rows = warc.with_revisits(table(spark, sf_dir, "pages"))
    warc.write_archives(rows, folder).agg(F.sum("records")).collect()  # one number: writing is over
    back = warc.read_archives(spark, folder).filter("record_type in ('response', 'revisit')")
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("long")
    return back.withColumn("page_id", number("record_id")).withColumn("refers_to", number("refers_to")).select(*OP8)


def op9_html_extraction(spark, sf_dir):
    from . import wrapper
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark, sf_dir):
    """Encode every document, decode what came out, and digest the ids."""
    from pyspark.sql import functions as F
    from . import pieces
    out = pieces.round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "n_byte_pieces", F.sha2(F.array_join("piece_ids", " "), 256).alias("ids_sha256"),
                      "n_chars", "round_trip")


def op11_fill_in_middle(spark, sf_dir):
    """Rearrange every document, rebuild each text from its output and form, and digest both."""
    from pyspark.sql import functions as F
    from . import fim
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                      sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_tokenizer_alignment(spark, sf_dir):
    from . import align
    return align.align_corpus(table(spark, sf_dir, "documents"))


def op13_source_mixture(spark, sf_dir):
    from . import mixture
    return mixture.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Units by the same pattern; cuts from the same digest groups, parts joined from the unit list.
OP11_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
cut AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM parts
"""


#: The same mix in plain steps: all quotients of all seats are ranked, all blocks listed, and documents held against
#: the chosen ones by their ranges of words.
OP13_SQL = """
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
summed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(ceil(sqrt(count(*))) AS BIGINT) AS shards,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS words,
         count(*) OVER () AS sources FROM summed),
levels AS (
  SELECT a.*, a.words - coalesce((SELECT sum(3 * b.source_size) FROM weighed b WHERE (b.source_size / b.weight, b.rank) < (a.source_size / a.weight, a.rank)), 0) AS rest,
         (SELECT sum(b.weight) FROM weighed b WHERE (b.source_size / b.weight, b.rank) >= (a.source_size / a.weight, a.rank)) AS heavy FROM weighed a),
stopped AS (SELECT *, CAST(3 * source_size AS DOUBLE) * heavy <= CAST(rest AS DOUBLE) * weight AS stops FROM levels),
sources AS (
  SELECT source, rank, source_size, shards, stops, CAST(CASE WHEN stops THEN 3 * source_size ELSE
           (SELECT arg_min(rest, (source_size / weight, rank)) FROM stopped WHERE NOT stops) * weight /
           (SELECT arg_min(heavy, (source_size / weight, rank)) FROM stopped WHERE NOT stops) END AS DOUBLE) AS target,
         CAST(ceil(source_size / greatest(1.0::DOUBLE, words / (sources * 100000))) AS BIGINT) AS n FROM stopped),
votes AS (SELECT rank, n, target * n / source_size AS votes FROM sources WHERE NOT stops AND source_size > 0),
seats AS (SELECT rank, row_number() OVER (ORDER BY votes / (2 * s - 1) DESC, rank) AS place FROM (SELECT *, unnest(generate_series(1, 3 * n)) AS s FROM votes)),
won AS (SELECT rank, count(*) AS won FROM seats WHERE place <= (SELECT round(sum(votes)) FROM votes) GROUP BY rank),
quotas AS (
  SELECT s.*, CASE WHEN n = 0 THEN 0 ELSE quota // n END AS passes, CASE WHEN n = 0 THEN 0 ELSE quota % n END AS left_over, CASE WHEN n = 0 THEN 0 ELSE source_size // n END AS width,
         CASE WHEN n = 0 THEN 0 ELSE source_size % n END AS longer
  FROM (SELECT sources.*, CASE WHEN stops THEN 3 * n ELSE least(coalesce(won, 0), 3 * n) END AS quota FROM sources LEFT JOIN won USING (rank)) s),
placed AS (
  SELECT d.doc_id, d.size, q.rank, CAST('0x' || d.digest[1:7] AS BIGINT) % q.shards AS shard, d.digest FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
line AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY shard, digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed),
shards AS (SELECT rank, shard, min(start) AS a, sum(size) AS length FROM line GROUP BY rank, shard),
blocks AS (
  SELECT rank, block, block * width + least(block, longer) AS a, (block + 1) * width + least(block + 1, longer) AS z, left_over
  FROM (SELECT *, unnest(generate_series(0, n - 1)) AS block FROM quotas WHERE n > 0 AND left_over > 0)),
dealt AS (SELECT b.*, s.shard, count(*) OVER (PARTITION BY b.rank, s.shard) AS own FROM blocks b JOIN shards s ON b.rank = s.rank AND b.a >= s.a AND b.a < s.a + s.length),
shard_seats AS (
  SELECT rank, shard, left_over, row_number() OVER (PARTITION BY rank ORDER BY own / (2 * s - 1) DESC, shard) AS place
  FROM (SELECT *, unnest(generate_series(1, own)) AS s FROM (SELECT DISTINCT rank, shard, own, left_over FROM dealt))),
shard_won AS (SELECT rank, shard, count(*) AS won FROM shard_seats WHERE place <= left_over GROUP BY rank, shard),
chosen AS (
  SELECT rank, a, z FROM (SELECT d.*, w.won, row_number() OVER (PARTITION BY d.rank, d.shard ORDER BY md5('13:' || d.rank || ':' || d.block), d.block) AS place
                          FROM dealt d JOIN shard_won w USING (rank, shard)) WHERE place <= won),
spans AS (
  SELECT l.rank, l.start, sum(least(l.start + l.size, c.z) - greatest(l.start, c.a)) AS more
  FROM line l JOIN chosen c ON l.rank = c.rank AND c.a < l.start + l.size AND c.z > l.start WHERE l.size > 0 GROUP BY l.rank, l.start)
SELECT l.doc_id, l.size, q.source_size, q.target, CAST(l.size * q.passes + CASE WHEN l.size > 0 THEN coalesce(s.more, 0) ELSE 0 END AS BIGINT) AS taken
FROM line l JOIN quotas q USING (rank) LEFT JOIN spans s ON l.rank = s.rank AND l.start = s.start
"""


def check_imports() -> None:
    """Import every operator module, so that a missing library shows here and not in the middle of a run."""
    from . import align, chat, compression, decontaminate, fim, langid, minhash, mixture, pieces, suffix, urls, warc, wrapper  # noqa: F401


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    found = dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
    return found | {"language_id_pages": language_id_pages}


def oracle_sql() -> dict:
    return {"op11_fill_in_middle": OP11_SQL, "op13_source_mixture": OP13_SQL}
