"""URL filters by a path-template tree (operator 1).

All paths of a host form a tree of segments.  Level by level, with plain grouping and joins:

- a child with enough urls and a large enough share of its node stays literal; the others are
  variable and become the wildcard of their shape (``{9}``, ``{9}.html``, ``{a9}``, ...);
- sibling branches whose next segments are distributed as those of all siblings together
  (Jensen-Shannon divergence) and whose labelled share of bad pages doesn't differ from theirs
  (two-proportion z) are merged into one branch, written ``~``;

Each template (host and path of branches) gets a labelled purity, smoothed towards its host's,
which is smoothed towards that of all pages; templates below the limit are blocked.  Explicit
rules go before the tree.

Cases: a null url or one without ``://`` has an empty host and path and is judged like any other;
an empty path is the template of the host itself; paths may have any number of segments, but from
``split_depth`` segments on a node of fewer than ``min_urls`` urls is not split any more and ends in
``**``, which stands for all that follows; repeated urls count as often as they occur; pages without
a label, null ids and an empty label table leave the priors; ties can't arise (every limit is one
of counts); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TreeParams:
    min_urls: int = 20          # of a literal branch
    min_share: float = 0.02     # of its node's urls, so a node has 50 literal branches at most
    divergence: float = 0.05    # bits, up to which a branch looks like its siblings
    z: float = 2.0              # and the z up to which its bad share does
    prior: float = 20.0         # labelled pages that a parent's rate counts for
    min_purity: float = 0.5     # smoothed share of good pages of an allowed template
    split_depth: int = 8        # segments up to which nodes of fewer than min_urls urls are split, too


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``; A-Z of the host lower-cased; both empty without one."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the (verdict, "host/path") rules that fits as a struct (rule, verdict), else null.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    """Wildcard of a segment: its kinds of characters, and a short extension as it is."""
    body, tail = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    return F.when(segment == "", "").otherwise(F.concat(F.lit("{"), F.when(body.rlike("[0-9]"), "9").otherwise(""), F.when(body.rlike("[A-Za-z]"), "a").otherwise(""),
                    F.when(body.rlike("[^0-9A-Za-z]"), "-").otherwise(""), F.lit("}"), tail))


def grow(rows: DataFrame, depth: int, p: TreeParams) -> DataFrame:
    """One level of the tree: rows (.., node, segs, lab, bad) with ``node`` a segment longer where the path has one."""
    rows = rows.withColumn("child", F.get("segs", F.lit(depth)))
    open_rows = rows.filter("child is not null")
    kids = open_rows.groupBy("node", "child").agg(F.count("*").alias("n"))
    totals = kids.groupBy(F.col("node").alias("t_node")).agg(F.sum("n").alias("total"))
    literal = (kids.filter(F.col("n") >= p.min_urls).join(totals, F.col("node") == F.col("t_node"))
               .filter(F.col("n") >= p.min_share * F.col("total"))
               .select(F.col("node").alias("l_node"), F.col("child").alias("l_child"), F.lit(True).alias("literal")))
    rows = rows.join(literal, (rows.node == literal.l_node) & (rows.child == literal.l_child), "left")
    rows = rows.withColumn("branch", F.when(F.col("literal"), F.col("child")).when(F.col("child").isNotNull(), shape(F.col("child"))))
    rows = stored(rows.drop("l_node", "l_child", "literal", "child"), "urls")

    # profiles of branches: what follows (a literal is its shape here), and the labels
    after = F.coalesce(shape(F.get("segs", F.lit(depth + 1))), F.lit("$"))
    cells = rows.filter("branch is not null").groupBy("node", "branch", after.alias("after")).agg(
        F.count("*").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    branches = cells.groupBy("node", "branch").agg(F.sum("n").alias("b_n"), F.sum("lab").alias("b_lab"), F.sum("bad").alias("b_bad"))
    pool = cells.groupBy(F.col("node").alias("p_node"), F.col("after").alias("p_after")).agg(F.sum("n").alias("p_n"))
    nodes = branches.groupBy(F.col("node").alias("n_node")).agg(
        F.sum("b_n").alias("n_n"), F.sum("b_lab").alias("n_lab"), F.sum("b_bad").alias("n_bad"), F.count("*").alias("n_branches"))
    q, r = F.coalesce(F.col("n") / F.col("b_n"), F.lit(0.0)), F.col("p_n") / F.col("n_n")
    half = (q + r) / 2
    part = F.when(q > 0, q * F.log2(q / half)).otherwise(0.0) / 2 + r * F.log2(r / half) / 2
    info = branches.join(nodes, F.col("node") == F.col("n_node"))
    wide = (info.join(pool, F.col("node") == F.col("p_node"))
            .join(cells.select(F.col("node").alias("c_node"), F.col("branch").alias("c_branch"), "after", "n"),
                  (F.col("node") == F.col("c_node")) & (F.col("branch") == F.col("c_branch")) & (F.col("p_after") == F.col("after")), "left"))
    rate = (F.col("n_bad") + 1) / (F.col("n_lab") + 2)
    error = F.sqrt(rate * (1 - rate) / F.greatest(F.col("b_lab"), F.lit(1)))
    similar = (wide.groupBy("node", "branch", "n_branches", "n_lab", "n_bad", "b_lab", "b_bad").agg(F.sum(part).alias("divergence"))
               .filter((F.col("divergence") <= p.divergence) & (F.col("n_branches") > 1)
                       & ((F.col("b_lab") == 0) | (F.abs(F.col("b_bad") / F.col("b_lab") - rate) <= p.z * error)))
               .select(F.col("node").alias("s_node"), F.col("branch").alias("s_branch"), F.lit(True).alias("similar")))
    rows = rows.join(similar, (rows.node == similar.s_node) & (rows.branch == similar.s_branch), "left")
    name = F.when(F.col("branch").isNotNull(), F.concat("node", F.lit("/"), F.when(F.col("similar"), "~").otherwise(F.col("branch"))))
    return rows.withColumn("node", F.coalesce(name, F.col("node"))).drop("branch", "s_node", "s_branch", "similar")


def deeper(rows: DataFrame, p: TreeParams) -> DataFrame:
    """Rows whose ``segs`` are what is left of long paths with their last ``node``: levels go on while nodes have enough urls.

    Segments that all urls of a node have in common are one step, as each is its node's only branch.
    """
    columns, done = rows.columns, []
    left = lambda n: F.slice("segs", n + 1, F.size("segs"))
    while True:
        same = F.transform(F.arrays_zip("lo", "hi"), lambda x: x["lo"].eqNullSafe(x["hi"]))
        nodes = rows.groupBy(F.col("node").alias("k_node")).agg(F.count("*").alias("k_n"), F.min("segs").alias("lo"), F.max("segs").alias("hi"))
        nodes = nodes.select("k_node", "k_n", F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("lo")).cast("int").alias("k"))
        rows = stored(rows.join(nodes, F.col("node") == F.col("k_node")), "urls")
        done.append(rows.filter(F.col("k_n") < p.min_urls).withColumn("node", F.concat("node", F.lit("/**"))).select(columns))
        rows = rows.filter(F.col("k_n") >= p.min_urls)
        name = F.when(F.col("k") > 0, F.concat("node", F.lit("/"), F.array_join(F.slice("segs", 1, F.col("k")), "/"))).otherwise(F.col("node"))
        rows = rows.withColumns({"node": name, "segs": left(F.col("k"))}).select(columns)
        done.append(rows.filter(F.size("segs") == 0))
        rows = rows.filter(F.size("segs") > 0)
        if rows.isEmpty():
            break
        rows = stored(grow(rows, 0, p).withColumn("segs", left(F.lit(1))).select(columns), "urls")
        done.append(rows.filter(F.size("segs") == 0))
        rows = rows.filter(F.size("segs") > 0)
        if rows.isEmpty():
            break
    return reduce(DataFrame.union, done)


def templates(rows: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """Rows (.., host, path, lab, bad) with their ``template``."""
    segs = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("path", "^/", ""), "/", -1))
    rows = stored(rows.withColumn("segs", segs).withColumn("node", F.col("host")), "urls")
    deepest = rows.agg(F.max(F.size("segs"))).first()[0] or 0
    for depth in range(min(deepest, p.split_depth)):
        rows = stored(grow(rows, depth, p), "urls")
    if deepest > p.split_depth:
        columns, size = rows.columns, F.size("segs")
        rest = rows.filter(size > p.split_depth).withColumn("segs", F.slice("segs", p.split_depth + 1, size))
        rows = rows.filter(size <= p.split_depth).union(deeper(rest, p).select(columns))
    return rows.withColumnRenamed("node", "template").drop("segs")


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, rules: list[tuple[str, str]] = (), p: TreeParams = TreeParams(),
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity, labelled) for every row of ``pages``.

    ``labels`` has (doc_id, quality 0/1, toxic 0/1) rows; a page is bad if its quality is 0 or it is toxic.
    """
    host, path = parse(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if labels is None:
        rows = rows.withColumns({"lab": F.lit(0), "bad": F.lit(0)})
    else:
        known = (labels.groupBy(F.col("doc_id").cast("long").alias("l_id"))
                 .agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("l_bad")).filter("l_bad is not null"))
        rows = (rows.join(known, rows.page_id == known.l_id, "left")
                .select("page_id", "host", "path", F.col("l_bad").isNotNull().cast("int").alias("lab"), F.coalesce("l_bad", F.lit(0)).alias("bad")))
    rows = templates(rows, p)
    counts = rows.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    hosts = counts.groupBy(F.col("host").alias("h_host")).agg(F.sum("lab").alias("h_lab"), F.sum("bad").alias("h_bad"))
    g = hosts.agg(F.coalesce(F.sum("h_bad") / F.nullif(F.sum("h_lab"), F.lit(0)), F.lit(0.0))).first()[0] or 0.0
    h_rate = (F.col("h_bad") + p.prior * F.lit(g)) / (F.col("h_lab") + p.prior)
    pure = counts.join(hosts, F.col("host") == F.col("h_host")).select(
        F.col("template").alias("t_template"), F.col("lab").alias("labelled"),
        (1 - (F.col("bad") + p.prior * h_rate) / (F.col("lab") + p.prior)).alias("purity"))
    out = rows.join(pure, rows.template == pure.t_template, "left").withColumn("found", rule_of(F.col("host"), F.col("path"), list(rules)))
    method = F.when(F.col("purity") < p.min_purity, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"),
                      "template", "purity", "labelled")
