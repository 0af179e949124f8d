"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks (operator 13).

Every source's documents are laid end to end, in seeded order, on a line of words that is cut into blocks of equal
size (within a word).  Blocks are the seats of an apportionment: they go to the sources with the highest quotients
``votes / (2 s - 1)``, votes being targets.  A source that gets as many blocks as it has, or more, takes
all of them once or twice; what is left of its blocks is apportioned in the same way to its shards, by their blocks,
and within each shard the blocks with the least seeded hash are taken.  A document takes the words that its blocks cover.

- ``targets``: shares of all words by weight; a source stops at ``most`` times its own size and the excess is shared out again.
  With sources in order of size / weight the ones that stop come first, so one running sum finds the level.
- A source has ceil(size / W) blocks, where W = all words / (``blocks`` x sources), at least one word.  An uncapped source's target is at
  least its weight's share of all words, so it has thousands of blocks and is off its target by half a block at most.
- ``apportion`` gives each party the seats below its share that are certain (n parties can move the last quotient by n / 2 seats
  only), so that only about two quotients of each party are ranked, not one for each seat.
- A source has about sqrt(documents) shards, dealt by hash, so neither a shard nor the list of a source's shards is ever
  long, however large the source.  Only the table of sources (a row each) is ordered as a whole.

Everything is DataFrame functions; hashes are MD5 of seed, id and text, so runs agree on any partitioning.

Cases: a null text has no words; an empty text takes nothing; rows without a source are a source of their own, last in
order; ids may be missing or stand on several rows, and rows equal in all are laid side by side; without words all
targets are 0; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in code point order (repeating), times a document may be taken, blocks a source, seed."""
    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    blocks: int = 100_000
    seed: int = 13


def _hash(*cells: Column) -> Column:
    """31 seeded bits and the whole digest of some cells, as a struct."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)))
    return F.struct(F.conv(F.substring(digest, 1, 7), 16, 10).cast("long").alias("bits"), digest.alias("digest"))


def measure(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, bits, digest): the words of each document and its seeded hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = _hash(F.lit(mix.seed), F.col(id_col), F.md5(text.cast("binary")))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key")).select("doc_id", "source", "size", "key.*")


def targets(rows: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, rank, target, shards, n, pace, votes) of (source, size) rows, one row a source."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("rank") % len(mix.weights) + 1).cast("int")).cast("long")
    sources = (rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.sqrt(F.count("*"))).cast("long").alias("shards"))
               .withColumn("rank", F.row_number().over(by_name).cast("long") - 1).withColumn("weight", weight)
               .withColumn("words", F.sum("source_size").over(every)).withColumn("sources", F.count("*").over(every)))
    # sources that stop: in order of size / weight, those that the level reaches
    limit = F.col("source_size") * mix.most
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("words") - F.coalesce(F.sum(limit).over(before), F.lit(0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = (sources.withColumn("rest", rest).withColumn("heavy", heavy)
              .withColumn("stops", limit.cast("double") * F.col("heavy") <= F.col("rest").cast("double") * F.col("weight")))
    first = F.min_by(F.struct("rest", "heavy"), F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "rank"))).over(every)
    target = F.when(F.col("stops"), limit.cast("double")).otherwise(F.col("level.rest") * F.col("weight") / F.col("level.heavy"))
    width = F.greatest(F.lit(1.0), F.col("words") / (F.col("sources") * mix.blocks))
    return (levels.withColumn("level", first).withColumn("target", target)
            .withColumn("n", F.ceil(F.col("source_size") / width).cast("long"))
            .withColumn("votes", F.when(F.col("stops") | (F.col("source_size") == 0), 0.0).otherwise(F.col("target") * F.col("n") / F.col("source_size")))
            .select("source", "source_size", "rank", "target", "shards", "n", "stops", "votes"))


def apportion(parties: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with ``won``: the seats that each party of a group has by highest quotients votes / (2 s - 1).

    ``seats`` is the group's number of seats, on each of its rows; ties go to the smaller party.
    """
    whole = Window.partitionBy(group)
    share = F.when((F.col(seats) > 0) & (F.col("all_votes") > 0), F.col(votes).cast("double") * F.col(seats) / F.col("all_votes")).otherwise(0.0)
    slack = F.when(F.col(seats) > 0, F.col("parties") / (F.col(seats) * 2)).otherwise(0.0)
    # one more on either side for the rounding of quotients
    sure = F.greatest(F.lit(0), F.floor(F.col("share") * (1 - slack) + 0.5) - 1)
    likely = F.when(F.col("share") > 0, F.floor(F.col("share") * (1 + slack) + 0.5) + 1).otherwise(0)
    rows = (parties.withColumn("all_votes", F.sum(votes).over(whole)).withColumn("parties", F.count("*").over(whole))
            .withColumn("share", share).withColumn("sure", sure.cast("long")).withColumn("likely", likely.cast("long"))
            .withColumn("open", F.col(seats) - F.sum("sure").over(whole)))
    seat = F.explode_outer(F.when(F.col("likely") > F.col("sure"), F.sequence(F.col("sure") + 1, F.col("likely"))))
    order = Window.partitionBy(group).orderBy((F.col(votes) / (F.col("seat") * 2 - 1)).desc_nulls_last(), party)
    ranked = rows.withColumn("seat", seat).withColumn("place", F.when(F.col("seat").isNotNull(), F.row_number().over(order)))
    more = ranked.groupBy(group, party).agg(F.count(F.when(F.col("place") <= F.col("open"), 1)).alias("more"), F.first("sure").alias("sure"))
    more = more.select(F.col(group).alias("w_group"), F.col(party).alias("w_party"), (F.col("sure") + F.col("more")).alias("won"))
    return parties.join(more, (F.col(group) == F.col("w_group")) & (F.col(party) == F.col("w_party"))).drop("w_group", "w_party")


def quotas(sources: DataFrame, mix: Mix) -> DataFrame:
    """(rank, n, passes, left): how often each source's blocks are all taken, and how many are taken once more."""
    every = Window.partitionBy()
    parties = sources.filter("not stops and votes > 0").withColumn("all", F.lit(0)).withColumn("seats", F.round(F.sum("votes").over(every)).cast("long"))
    won = apportion(parties, "all", "rank", "votes", "seats").select(F.col("rank").alias("q_rank"), "won")
    quota = F.when(F.col("stops"), F.col("n") * mix.most).otherwise(F.least(F.coalesce("won", F.lit(0)), F.col("n") * mix.most))
    return (sources.join(won, F.col("rank") == F.col("q_rank"), "left").withColumn("quota", quota)
            .withColumn("passes", F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0).cast("long"))
            .select("source", "source_size", "rank", "target", "shards", "n", "passes", (F.col("quota") - F.col("passes") * F.col("n")).alias("left")))


def block_at(place: Column) -> Column:
    """The block that holds a word of its source's line: the first ``longer`` blocks have ``width`` + 1 words, the others ``width``."""
    edge = F.col("longer") * (F.col("width") + 1)
    whole = lambda x, y: (x - x % y) / y  # exact
    return F.when(place < edge, whole(place, F.col("width") + 1)).otherwise(F.col("longer") + whole(place - edge, F.col("width"))).cast("long")


def block_start(block: Column) -> Column:
    return block * F.col("width") + F.least(block, F.col("longer"))


def lay_out(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, source, rank, shard, size, start, ..): each document's place on its source's line of words."""
    named = rows.withColumnRenamed("source", "d_source").join(sources, F.col("d_source").eqNullSafe(F.col("source")))
    named = named.withColumn("shard", F.col("bits") % F.col("shards"))
    lengths = named.groupBy(F.col("rank").alias("l_rank"), F.col("shard").alias("l_shard")).agg(F.sum("size").alias("length"))
    before = Window.partitionBy("l_rank").orderBy("l_shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = lengths.select("l_rank", "l_shard", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"), "length")
    inside = Window.partitionBy("rank", "shard").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (named.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(bases, (F.col("rank") == F.col("l_rank")) & (F.col("shard") == F.col("l_shard")))
            .select("doc_id", F.col("d_source").alias("source"), "size", "source_size", "rank", "target", "n", "passes", "left", "shard", "base", "length",
                    (F.col("base") + F.col("inside")).alias("start"))
            .withColumn("width", F.when(F.col("n") > 0, F.expr("source_size div n")).otherwise(0)).withColumn("longer", F.when(F.col("n") > 0, F.col("source_size") % F.col("n")).otherwise(0)))


def chosen_blocks(placed: DataFrame, mix: Mix) -> DataFrame:
    """(c_rank, c_block): the blocks taken once more, by shards' quotas and seeded hash."""
    # blocks belong to the shard that they start in
    edges = placed.filter("n > 0 and left > 0").groupBy("rank", "shard", "n", "left", "width", "longer", "base", "length").agg(F.lit(1).alias("one"))
    after = lambda place: F.when(place <= 0, F.lit(0)).otherwise(block_at(place - 1) + 1)  # blocks that start before a place
    shards = edges.select("rank", "shard", "left", after(F.col("base")).alias("lo"), after(F.col("base") + F.col("length")).alias("hi")).withColumn("own", F.col("hi") - F.col("lo"))
    won = apportion(shards.filter("own > 0"), "rank", "shard", "own", "left").filter("won > 0")
    blocks = won.select("rank", "shard", "won", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("block"))
    order = Window.partitionBy("rank", "shard").orderBy(_hash(F.lit(mix.seed), F.col("rank"), F.col("block"))["digest"], "block")
    return blocks.withColumn("place", F.row_number().over(order)).filter("place <= won").select(F.col("rank").alias("c_rank"), F.col("block").alias("c_block"))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, passes, spans) of every row of ``docs``.

    A document is taken whole ``passes`` times, and once more the words of its ``spans`` (first, stop).
    """
    rows = stored(measure(docs, mix, id_col, text_col, source_col), "sizes")
    sources = stored(quotas(targets(rows, mix), mix), "sources")
    placed = stored(lay_out(rows, sources), "placed")
    chosen = stored(chosen_blocks(placed, mix), "chosen")
    cuts = placed.filter("size > 0 and left > 0").withColumn("block", F.explode(F.sequence(block_at(F.col("start")), block_at(F.col("start") + F.col("size") - 1))))
    hits = cuts.join(chosen, (F.col("rank") == F.col("c_rank")) & (F.col("block") == F.col("c_block")))
    first = F.greatest(F.col("start"), block_start(F.col("block"))) - F.col("start")
    stop = F.least(F.col("start") + F.col("size"), block_start(F.col("block") + 1)) - F.col("start")
    spans = (hits.select("rank", "start", first.alias("first"), stop.alias("stop")).groupBy(F.col("rank").alias("s_rank"), F.col("start").alias("s_start"))
             .agg(F.sum(F.col("stop") - F.col("first")).alias("more"), F.sort_array(F.collect_list(F.struct("first", "stop"))).alias("spans")))
    # documents without words share a start with their neighbour and take nothing
    out = placed.join(spans, (F.col("rank") == F.col("s_rank")) & (F.col("start") == F.col("s_start")) & (F.col("size") > 0), "left")
    taken = F.col("size") * F.col("passes") + F.coalesce("more", F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", "spans")
