"""Isolation forests (M2, M3): grown level by level, applied as plan data.

Model after Liu, Ting & Zhou (2008), "Isolation Forest":
* each tree isolates a random sub-sample of <= 256 rows with random
  axis-parallel splits, depth limit ceil(log2(sub-sample));
* a row's score is ``2 ** (-E[h(x)] / c(256))`` where ``h`` is the path
  length (plus ``c(leaf size)`` for unfinished leaves); ``score_samples`` is
  its negative, ``decision = score_samples - offset`` and rows with a
  negative decision are outliers.

Fitting is an action, as in Spark's own model library: it writes the node table to the
shared folder.  The sub-samples (trees x <= 256 rows, whatever the data's size)
are dealt by tree, and a task grows all of its trees together, level by
level: a level is one sort by (tree, node) and the least and largest values of each
node; the split's feature and threshold come from draws of (seed, tree, node).
Nodes are numbered as in a heap (children 2n + 1 and 2n + 2).

Scoring starts no job while a query is built: a scalar subquery packs the forest
into one array, and the first row of every partition carries it to the Arrow
scorer.  The contamination offset belongs to the fit and is a row of the
forest's own table (``tree = -1``).

Fleets: a device's few hundred hourly rows are one group, and its trees grow in the same way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import draw, draw_np
from ..functions.quantiles import exact_percentile
from ..session import saved

FEATURES = ["value", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "rolling_mean", "rolling_std", "diff_from_mean"]

# Fixed values of the detector.
MAX_SAMPLES = 256
MIN_TRAINING_ROWS = 48
AUTO_OFFSET = -0.5             # offset when contamination is "auto"
OVERSAMPLE = 4                 # expected candidates per tree = OVERSAMPLE * MAX_SAMPLES
EULER_GAMMA = 0.5772156649015329
LEVELS = int(math.log2(MAX_SAMPLES))
NODES = 2 * MAX_SAMPLES - 1
#: Salts of a tree's draws: its sample, its features, a node's feature and threshold.
SAMPLE, SUBSET, PICK, CUT = 1, 2, 3, 4
OFFSET_TREE = -1

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("leaf_size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])


def average_path_length(n) -> np.ndarray:
    """c(n): mean path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _key_number(df: DataFrame, key: str) -> F.Column:
    """A row key as a non-negative whole number for draws."""
    kind = df.schema[key].dataType
    return F.pmod(F.col(key).cast("bigint"), F.lit(2 ** 62)) if isinstance(kind, T.IntegralType) else F.pmod(F.xxhash64(key), F.lit(2 ** 62))


# ---------------------------------------------------------------- M2
def sub_samples(features: DataFrame, n_estimators: int, seed: int, key: str) -> DataFrame:
    """(tree, key, f array): the rows of each tree, those with the least draws; none for under 48 rows.

    A draw that all trees share comes first and lets pass about 4 x 256 rows per tree, so a tree's draws are made
    for those only, however many rows there are.
    """
    want = float(OVERSAMPLE * MAX_SAMPLES)
    rows = features.select(F.col(key).alias("row_key"), _key_number(features, key).alias("k"), F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("f"))
    rows = rows.withColumn("n", features.agg(F.count(F.lit(1))).scalar())
    any_tree = F.least(F.lit(1.0), F.lit(n_estimators * want) / F.col("n"))
    rows = rows.withColumn("any_tree", any_tree).filter((F.col("n") >= MIN_TRAINING_ROWS) & (draw(seed, SAMPLE, F.col("k")) < F.col("any_tree")))
    cand = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_estimators - 1))))
    per_tree = F.least(F.lit(1.0), F.lit(want) / (F.col("any_tree") * F.col("n")))
    cand = cand.withColumn("h", draw(seed, SAMPLE, F.col("tree") + 1, F.col("k"))).filter(F.col("h") < per_tree)
    place = F.row_number().over(Window.partitionBy("tree").orderBy("h", "row_key"))
    return cand.withColumn("place", place).filter(F.col("place") <= MAX_SAMPLES).select("tree", "f")


_GROWN = ("node", "feature", "threshold", "leaf_size", "depth")


def grow_trees(of: np.ndarray, numbers: np.ndarray, shares: np.ndarray, x: np.ndarray, seed: int) -> dict:
    """Nodes of all trees of some sample rows: row i of ``x`` belongs to tree ``of[i]``, a place in ``numbers`` and ``shares``.

    ``numbers`` are the trees' numbers for draws, ``shares`` their max_features.
    Returns arrays: place of the tree, node, feature (-1 for a leaf), threshold, leaf_size, depth.
    """
    n_trees, n_features = len(numbers), x.shape[1]
    limit = np.array([math.ceil(math.log2(max(c, 2))) for c in np.bincount(of, minlength=n_trees)])
    sizes = np.maximum(1, np.floor(shares * n_features).astype(np.int64))
    by_draw = np.argsort(draw_np(seed, SUBSET, numbers[:, None], np.arange(n_features)[None, :]), axis=1, kind="stable")
    subset = np.zeros((n_trees, n_features), bool)
    subset[np.arange(n_trees)[:, None], by_draw] = np.arange(n_features)[None, :] < sizes[:, None]
    node, live, found = np.zeros(len(x), np.int64), np.arange(len(x)), []
    for depth in range(LEVELS + 1):
        if not len(live):
            break
        cell = of[live] * NODES + node[live]
        order = np.argsort(cell, kind="stable")
        cell, live = cell[order], live[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        count = np.diff(np.append(first, len(cell)))
        tree, at = np.divmod(cell[first], NODES)
        values = x[live]
        lo, hi = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
        usable = (hi > lo) & subset[tree]
        choices = usable.sum(axis=1)
        split = (count > 1) & (choices > 0) & (depth < limit[tree])
        pick = np.floor(draw_np(seed, PICK, numbers[tree], at) * choices).astype(np.int64)
        chosen = np.argmax(np.cumsum(usable, axis=1) > pick[:, None], axis=1)
        low, high = (edge[np.arange(len(first)), chosen] for edge in (lo, hi))
        cut = low + draw_np(seed, CUT, numbers[tree], at) * (high - low)
        found.append((tree, at, np.where(split, chosen, -1), np.where(split, cut, 0.0), np.where(split, 0, count), np.full(len(first), depth)))
        of_cell = np.repeat(np.arange(len(first)), count)
        on = split[of_cell]
        live, of_cell, values = live[on], of_cell[on], values[on]
        right = values[np.arange(len(live)), chosen[of_cell]] >= cut[of_cell]
        node[live] = 2 * node[live] + 1 + right
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 6
    return dict(zip(("place", *_GROWN), columns))


def grow(samples: DataFrame, max_features: float = 1.0, seed: int = 42, by: str | None = None) -> DataFrame:
    """(NODE_SCHEMA) nodes of (tree, f) sample rows; with ``by``, a column of max_features shares, each share has its own trees."""
    keys = ([by] if by else []) + ["tree"]
    rows = samples.select(*keys, "f").repartition(*keys)
    schema = T.StructType(([T.StructField(by, T.DoubleType())] if by else []) + NODE_SCHEMA.fields)

    def run(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        table = pa.Table.from_batches(parts)  # whole trees of <= 256 rows
        tree = table.column("tree").to_numpy()
        share = table.column(by).to_numpy() if by else np.full(len(tree), float(max_features))
        trees, of = np.unique(np.stack([share, tree], axis=1), axis=0, return_inverse=True)
        x = table.column("f").combine_chunks().flatten().to_numpy().reshape(len(tree), -1)
        g = grow_trees(of.ravel(), trees[:, 1].astype(np.int64), trees[:, 0], x, seed)
        inner = g["feature"] >= 0
        columns = {"tree": trees[g["place"], 1], "left": np.where(inner, 2 * g["node"] + 1, -1), "right": np.where(inner, 2 * g["node"] + 2, -1), **g}
        if by:
            columns[by] = trees[g["place"], 0]
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64()).cast(
            pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int32()) for f in schema.fields], names=schema.names)

    return rows.mapInArrow(run, schema)


def fit_isolation_forest(features: DataFrame, n_estimators: int = 100, contamination: float | str = "auto", max_features: float = 1.0,
                         seed: int = 42, key: str = "row_key") -> DataFrame:
    """M2: forest node table ``(tree, node, feature, threshold, left, right, leaf_size, depth)``.

    ``features`` holds the :data:`FEATURES` columns and a unique ``key``.  With a
    ``contamination`` share, one more row (``tree = -1``) has the decision offset
    as its threshold: that quantile of the training rows' scores.
    """
    if contamination not in (None, "auto") and not 0.0 < float(contamination) <= 0.5:
        raise ValueError("contamination must be 'auto' or in (0, 0.5]")
    columns = [c for c in (key, *FEATURES)]
    features = saved(features.select(*columns), "training")  # counted, sampled and scored
    nodes = saved(grow(sub_samples(features, n_estimators, seed, key), max_features, seed), "forest")
    if contamination in (None, "auto"):
        return nodes
    # one exchange behind the scorer: the quantile looks at the scores several times
    scored = with_raw_score(features.select(*FEATURES), nodes).select("raw_score").repartition("raw_score")
    offset = exact_percentile(scored, "raw_score", float(contamination)).filter("value is not null")
    offset = offset.filter(nodes.agg(F.count(F.lit(1)) > 0).scalar())  # no trees, no offset
    values = {"tree": F.lit(OFFSET_TREE), "node": F.lit(0), "feature": F.lit(-1), "threshold": F.col("value"), "left": F.lit(-1), "right": F.lit(-1),
              "leaf_size": F.lit(0), "depth": F.lit(0)}
    return nodes.union(saved(offset.select(*[c.alias(n) for n, c in values.items()]), "offset"))


def forest_offset(forest: DataFrame) -> F.Column:
    """The decision offset of a forest: its contamination quantile, or -0.5."""
    own = forest.filter(F.col("tree") == OFFSET_TREE).agg(F.max("threshold")).scalar()
    return F.coalesce(own, F.lit(AUTO_OFFSET))


# ---------------------------------------------------------------- M3
class Packed:
    """Trees as dense arrays over heap-numbered nodes: [tree, node] feature, threshold, path length of a leaf."""

    def __init__(self, tree: np.ndarray, node: np.ndarray, feature: np.ndarray, threshold: np.ndarray, leaf_size: np.ndarray):
        names, at = np.unique(tree, return_inverse=True)
        self.feature, self.threshold = np.full((len(names), NODES), -1, np.int8), np.zeros((len(names), NODES))
        depth = np.floor(np.log2(np.arange(NODES) + 1))
        self.path = np.broadcast_to(depth, (len(names), NODES)).copy()  # a child without rows is an empty leaf
        self.feature[at, node], self.threshold[at, node] = feature, threshold
        self.path[at, node] += average_path_length(leaf_size)

    def paths(self, x: np.ndarray) -> np.ndarray:
        """[row, tree] path lengths."""
        trees = np.arange(len(self.path))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.path)), np.int64)
        for _ in range(LEVELS):
            f = self.feature[trees, node]
            active = f >= 0
            if not active.any():
                break
            right = x[rows, np.maximum(f, 0)] >= self.threshold[trees, node]
            node = np.where(active, 2 * node + 1 + right, node)
        return self.path[trees, node]


def raw_scores(paths: np.ndarray) -> np.ndarray:
    """``score_samples`` of [row, tree] path lengths: -2 ** (-mean / c(256)); 0 without trees."""
    if not paths.shape[1]:
        return np.zeros(len(paths))
    return -np.power(2.0, -paths.mean(axis=1) / average_path_length([MAX_SAMPLES])[0])


#: Rows scored together: rows x trees path lengths are held at once.
TOGETHER = 2048


def score_rows(df: DataFrame, forest: DataFrame, columns: T.StructType, scores, by: tuple = ()) -> DataFrame:
    """``df`` with the ``columns`` that ``scores(packed trees by group, x)`` gives, the forest sent along with the rows.

    The packed forest is a scalar subquery (at most 500 trees x 511 nodes); only the
    first row of a partition carries it, and the scorer keeps it for the others.
    """
    cells = F.struct(*by, "tree", "node", "feature", "threshold", "leaf_size")
    packed = forest.filter(F.col("tree") >= 0).agg(F.collect_list(cells)).scalar()
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(2 ** 33 - 1)) == 0
    names = df.columns
    rows = df.select(*names, F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("_x"), F.when(first, packed).alias("_forest"))

    def run(batches):
        model = None
        for batch in batches:
            sent = batch.column(len(names) + 1)
            if model is None and len(batch):
                cells = sent.flatten() if isinstance(sent, pa.ListArray) else sent.combine_chunks().flatten()
                if not sent[0].is_valid:
                    raise ValueError("the first row of a partition brings the forest")
                cell = {f.name: cells.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(cells.type)}
                model = _packed_groups(cell, by)
            for a in range(0, len(batch), TOGETHER):
                part = batch.slice(a, TOGETHER)
                flat = part.column(len(names)).flatten().to_numpy(zero_copy_only=False).astype(float)
                found = scores(model, flat.reshape(len(part), -1))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], *found], names=[*names, *columns.names])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, *columns.fields]))


def _packed_groups(cell: dict, by: tuple) -> dict:
    """{group: Packed}; the only group is () without ``by``."""
    pick = lambda m: Packed(*(cell[c][m] for c in ("tree", "node", "feature", "threshold", "leaf_size")))
    if not by:
        return {(): pick(slice(None))}
    groups = sorted(set(zip(*(cell[c].tolist() for c in by))))
    return {g: pick(np.logical_and.reduce([cell[c] == v for c, v in zip(by, g)])) for g in groups}


def with_raw_score(df: DataFrame, forest: DataFrame) -> DataFrame:
    """``df`` with ``raw_score`` (score_samples)."""
    kind = T.StructType([T.StructField("raw_score", T.DoubleType())])
    return score_rows(df, forest, kind, lambda model, x: [pa.array(raw_scores(model[()].paths(x)))])


# ---------------------------------------------------------------- one small series as arrays
def fit_score_np(x: np.ndarray, n_estimators: int, max_features: float, seed: int) -> np.ndarray:
    """``score_samples`` of all rows of one small training set by a forest grown on them."""
    n = len(x)
    trees = np.arange(n_estimators)
    if n > MAX_SAMPLES:
        h = draw_np(seed, SAMPLE, trees[:, None] + 1, np.arange(n)[None, :])
        rows = np.argsort(h, axis=1, kind="stable")[:, :MAX_SAMPLES].ravel()
    else:
        rows = np.tile(np.arange(n), n_estimators)
    of = np.repeat(trees, len(rows) // n_estimators)
    g = grow_trees(of, trees, np.full(n_estimators, float(max_features)), x[rows], seed)
    return raw_scores(Packed(g["place"], g["node"], g["feature"], g["threshold"], g["leaf_size"]).paths(x))
