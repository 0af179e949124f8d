"""Near-duplicate detection by MinHash with tensored banding (operator 5).

A document's set holds its distinct word shingles.  Two collections A and B of ``m`` keys each are
computed, a key joining ``r`` minhashes; table (i, j) is keyed by the pair (A_i, B_j).  So m * m
tables of 2 r minhashes each come from 2 m r minhashes, about the square root of what separate
tables would take.  Documents of similarity s meet with probability (1 - (1 - s**r)**m)**2: 0.99993
at the limit of 0.85 with r = 4, m = 14.

1. Documents with equal sets are one node (128-bit set hash and size).
2. A node that shares no A_i with any other meets nobody in the tables (i, j), so B_j is joined on
   only where A_i collides.
3. Each bucket has a pivot (the node that meets most others in all tables); its nodes are verified against the pivot, never
   all pairs.  Verification is exact, on full sets: a pivot's set meets its members' sets one by one.
4. Nodes X and Y that met pivot P without both being linked to it may still be linked with each
   other.  With D(X) the symmetric difference of X and P, |X n Y| follows from |D(X) n D(Y)|, and a
   node that isn't linked with P must share an element of D with any partner.  So D(X) is looked up
   in an inverted index of the members' differences: exact overlaps without expanding pairs, in
   blocks of bounded size.  Only links between different components come back.

Cases: null texts count as empty; empty sets are linked with nothing; rows without an id are kept,
linked with nothing, and have a null component; rows that share an id are judged by their own
texts; components are named by their smallest id, so ties don't matter; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, as_text, lean, mix, shingle_sets, stored, text_slices
from .graph import components

#: Members that meet one copy of a pivot's set, and bytes of differences in a block.
CHUNK, BLOCK_BYTES = 512, 8 << 20
#: Bytes of candidate ids up to which they are sent to all executors; beyond, texts are joined by shuffle.
BROADCAST_BYTES, ID_BYTES = 64 << 20, 32


@dataclass(frozen=True)
class Near:
    """Shingle words, similarity num / den, minhashes per key and keys per collection."""
    words: int = 3
    num: int = 85
    den: int = 100
    r: int = 4
    m: int = 14
    seed: int = 7


def signature(values: np.ndarray, first: np.ndarray, p: Near) -> np.ndarray:
    """[row, 2 m] keys of the collections A and B; rows must not be empty."""
    rng = np.random.default_rng(p.seed)
    factors = rng.integers(0, 1 << 63, 2 * p.m * p.r, dtype=np.uint64) * U(2) + U(1)
    out = np.zeros((len(first) - 1, 2 * p.m), U)
    for k in range(2 * p.m):
        h = np.full(len(first) - 1, k + 1, U)
        for f in factors[k * p.r:(k + 1) * p.r]:
            h = mix(h * U(0x9FB21C651E98DF25) + np.minimum.reduceat(values * f, first[:-1]))
        out[:, k] = h
    return out


def set_hash(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 order-free bits of each set, as two columns of 64."""
    def sums(x):
        total = np.concatenate([[U(0)], np.cumsum(x, dtype=U)])
        return (total[first[1:]] - total[first[:-1]]).view(np.int64)
    return sums(mix(values ^ U(0x5851F42D4C957F2D))), sums(mix(values ^ U(0x14057B7EF767814F)))


def signatures(docs: DataFrame, p: Near) -> DataFrame:
    """(doc_id, n, s1, s2, keys array<long>) of (doc_id, text) rows; keys are null for empty sets."""
    def run(batches):
        for batch in batches:
            for a, b, raw, offs in text_slices(batch.column(1)):
                values, first = shingle_sets(raw, offs, p.words)
                n = np.diff(first)
                s1, s2 = set_hash(values, first)
                full = np.flatnonzero(n)
                keys = signature(values, np.append(first[:-1][full], len(values)), p).view(np.int64) if len(full) else np.zeros((0, 2 * p.m), np.int64)
                ends = np.concatenate([[0], np.cumsum(n > 0)]) * 2 * p.m
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(s1), pa.array(s2),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))],
                                                 names=["doc_id", "n", "s1", "s2", "keys"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, s1 long, s2 long, keys array<long>")


def buckets(nodes: DataFrame, p: Near) -> DataFrame:
    """(bucket, node, size): the table keys that at least two nodes share, with the number of nodes."""
    a = nodes.select(F.explode(F.slice("keys", 1, p.m)).alias("a"), "node")  # a key holds its own number
    shared = a.groupBy(F.col("a").alias("a_shared")).agg(F.count("*").alias("k")).filter("k > 1").select("a_shared")
    alive = a.join(shared, F.col("a") == F.col("a_shared"), "left_semi").groupBy(F.col("node").alias("a_node")).agg(F.collect_list("a").alias("own"))
    both = nodes.select("node", F.slice("keys", p.m + 1, p.m).alias("b")).join(alive, F.col("node") == F.col("a_node"))
    keys = both.select("node", "b", F.explode("own").alias("a")).select("node", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("bucket"), "node")
    keys = stored(keys, "buckets")
    twice = keys.groupBy(F.col("bucket").alias("b_shared")).agg(F.count("*").alias("size")).filter("size > 1")
    return keys.join(twice, F.col("bucket") == F.col("b_shared")).drop("b_shared")


def sets_of(docs: DataFrame, wanted: DataFrame, p: Near) -> DataFrame:
    """(node, members binary): sorted shingle hashes of the wanted (node, rep, s1) nodes, from their texts."""
    wanted = stored(wanted, "wanted")
    small = wanted.count() * ID_BYTES <= BROADCAST_BYTES
    rows = docs.join(F.broadcast(wanted) if small else wanted, F.col("doc_id") == F.col("rep")).select("node", "s1", "text")

    def run(batches):
        for batch in batches:
            s1 = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, raw, offs in text_slices(batch.column(2)):
                values, first = shingle_sets(raw, offs, p.words)
                right = np.flatnonzero(set_hash(values, first)[0] == s1[a:b])
                data = values.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(right)),
                                                  pa.array([data[8 * first[i]:8 * first[i + 1]] for i in right], pa.binary())], names=["node", "members"])

    return stored(rows.mapInArrow(lean(run), "node long, members binary").dropDuplicates(["node"]), "sets")


def verify(pairs: DataFrame, sets: DataFrame, p: Near, differences: bool = False) -> DataFrame:
    """(node, pivot, n, p_n, linked) of (node, pivot) pairs, by exact intersection of full sets.

    With ``differences``, also ``diff``: the symmetric difference of both sets.
    """
    sizes = pairs.groupBy(F.col("pivot").alias("c_pivot")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, F.col("pivot") == F.col("c_pivot")).select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"))
    own = sets.select(F.col("node").alias("s_node"), "members")
    members = dealt.join(own, F.col("node") == F.col("s_node")).select("pivot", "chunk", "node", "members")
    heads = dealt.select("pivot", "chunk").distinct().join(own, F.col("pivot") == F.col("s_node")).select("pivot", "chunk", F.lit(None).cast("long").alias("node"), "members")
    rows = members.union(heads).repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", F.col("node").asc_nulls_first())
    names = ["node", "pivot", "n", "p_n", "linked"] + ["diff"] * differences

    def run(batches):
        head, of = np.zeros(0, U), None
        for batch in batches:
            out, diffs = ([], [], [], [], []), []
            for pivot, node, members in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                values = np.frombuffer(members.as_buffer(), U)
                if node is None:
                    head, of = values, pivot
                    continue
                assert of == pivot, "a pivot's set comes first"
                hit = np.zeros(len(values), bool)
                if len(head):
                    at = np.searchsorted(head, values)
                    hit = head[np.minimum(at, len(head) - 1)] == values
                both = int(np.count_nonzero(hit))
                for c, x in zip(out, (node, pivot, len(values), len(head), p.den * both >= p.num * (len(values) + len(head) - both))):
                    c.append(x)
                if differences:
                    left = np.ones(len(head), bool)
                    left[at[hit]] = False
                    diffs.append(np.concatenate([values[~hit], head[left]]).tobytes())
            columns = [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(out[4], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(diffs, pa.binary())] * differences, names=names)

    return rows.mapInArrow(lean(run), "node long, pivot long, n long, p_n long, linked boolean" + ", diff binary" * differences)


def partners(rows: list[tuple], first: int, second: int, p: Near) -> list[tuple[int, int]]:
    """Links between different components of one pivot's members, of blocks ``first`` and ``second``.

    Rows are (block, node, component, n, linked with the pivot, differences from the pivot).
    """
    diffs = [np.frombuffer(r[5], U) for r in rows]
    block, comp, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 2, 3))
    d = np.array([len(x) for x in diffs], np.int64)
    owner = np.repeat(np.arange(len(rows)), d)
    values = np.concatenate(diffs) if len(owner) else np.zeros(0, U)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = []
    for x in np.flatnonzero(~np.array([r[4] for r in rows], bool)):
        a, b = np.searchsorted(values, diffs[x], "left"), np.searchsorted(values, diffs[x], "right")
        many = np.flatnonzero(b - a > 1)  # elements of others, too
        if not len(many):
            continue
        shared = np.bincount(np.concatenate([owner[i:j] for i, j in zip(a[many], b[many])]), minlength=len(rows))
        apart = d[x] + d - 2 * shared
        total = n[x] + n
        ok = (p.den * (total - apart) >= p.num * (total + apart)) & (comp != comp[x]) & (shared > 0)
        if first != second:
            ok &= block != block[x]
        ys = np.flatnonzero(ok)
        if len(ys):
            _, one = np.unique(comp[ys], return_index=True)  # one link to each component is enough
            out += [(int(rows[x][1]), int(rows[y][1])) for y in ys[one]]
    return out


def other_links(judged: DataFrame, found: DataFrame, sets: DataFrame, p: Near) -> DataFrame:
    """(u, v): links between members of one pivot that are still in different components."""
    label = found.select(F.col("node").alias("f_node"), "component")
    named = judged.join(label, F.col("node") == F.col("f_node"), "left").select("node", "pivot", "linked", F.coalesce("component", "node").alias("component"))
    mixed = (named.groupBy(F.col("pivot").alias("m_pivot")).agg(F.count("*").alias("k"), F.min("linked").alias("all_linked"),
                                                               F.min("component").alias("least"), F.max("component").alias("most"))
             .filter("k > 1 and not all_linked and least <> most").select("m_pivot"))
    left = stored(named.join(mixed, F.col("pivot") == F.col("m_pivot"), "left_semi"), "left")
    rows = verify(left.select("node", "pivot"), sets, p, differences=True).withColumnRenamed("node", "v_node").withColumnRenamed("pivot", "v_pivot")
    rows = stored(rows, "differences")
    blocks = rows.groupBy(F.col("v_pivot").alias("b_pivot")).agg(F.ceil(F.sum(F.octet_length("diff") + 64) / BLOCK_BYTES).cast("int").alias("blocks"))
    rows = rows.join(left.select("node", "pivot", "component"), (F.col("node") == F.col("v_node")) & (F.col("pivot") == F.col("v_pivot"))).join(blocks, F.col("pivot") == F.col("b_pivot"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = rows.select("pivot", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "component", "n", "linked", "diff")
    units = units.repartition("pivot", "first", "second").sortWithinPartitions("pivot", "first", "second", "node")

    def run(batches):
        held, now = [], None
        pack = lambda e: pa.RecordBatch.from_arrays([pa.array([x[i] for x in e], pa.int64()) for i in (0, 1)], names=["u", "v"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    if len(held) > 1:
                        yield pack(partners(held, now[1], now[2], p))
                    held, now = [], row[:3]
                held.append(row[3:])
        if len(held) > 1:
            yield pack(partners(held, now[1], now[2], p))

    return units.mapInArrow(lean(run), "u long, v long")


def links(nodes: DataFrame, docs: DataFrame, p: Near) -> DataFrame:
    """(node, component) of the nodes linked with another; ``nodes`` has (node, rep, n, s1, keys)."""
    table = stored(buckets(nodes, p), "buckets")
    # the node that meets most others leads its buckets, so near copies of one text share few pivots
    weight = table.groupBy(F.col("node").alias("w_node")).agg((-F.sum("size")).alias("w"))
    order = F.struct("w", F.xxhash64("node", F.lit(p.seed)).alias("o"), F.col("node").alias("pivot"))
    pivots = (table.join(weight, F.col("node") == F.col("w_node")).groupBy(F.col("bucket").alias("p_bucket")).agg(F.min(order).alias("p")))
    pairs = table.join(pivots.select("p_bucket", "p.pivot"), F.col("bucket") == F.col("p_bucket")).filter("node <> pivot").select("node", "pivot").distinct()
    size = nodes.select(F.col("node").alias("z_node"), "n", "rep", "s1")
    pairs = stored(pairs, "pairs")
    wanted = pairs.select("node").union(pairs.select("pivot")).distinct().join(size, F.col("node") == F.col("z_node")).select("node", "rep", "s1")
    sets = sets_of(docs, wanted, p)
    judged = stored(verify(pairs, sets, p), "judged")
    edges = judged.filter("linked").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    found = stored(components(edges), "components")
    more = stored(other_links(judged, found, sets, p), "links")
    return components(edges.union(more)) if not more.isEmpty() else found


def near_duplicates(docs: DataFrame, p: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    texts = as_text(docs, id_col, text_col)
    rows = stored(signatures(texts, p), "signatures")
    some = rows.filter("n > 0 and doc_id is not null")
    nodes = some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = links(nodes, texts, p)
    named = nodes.select("s1", "s2", "n", "rep", "node").join(found.withColumnRenamed("node", "f_node"), F.col("node") == F.col("f_node"), "left").drop("f_node")
    least = named.filter("component is not null").groupBy(F.col("component").alias("l_component")).agg(F.min("rep").alias("least"))
    named = named.join(least, F.col("component") == F.col("l_component"), "left").select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n").alias("c_n"), F.coalesce("least", "rep").alias("name"))
    out = rows.select("doc_id", "n", "s1", "s2").join(named, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") == F.col("c_n")), "left")
    name = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.coalesce(F.col("doc_id") == name, F.lit(True)).alias("kept"))
