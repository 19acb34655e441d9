"""Isolation forest and Shapley attribution over distinct feature vectors."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.features import FEATURES, WEIGHTS
from casewright.session import checkpointed

TREES, SAMPLE, CONTAMINATION, SEED, BACKGROUND = 200, 256, 0.01, 42, 64
#: Trees of a forest whose nodes are broadcast: ten families of two hundred.
BROADCAST_TREES = 2000
#: Distinct vectors whose scores and texts are broadcast to the items.
BROADCAST_VECTORS = 5000


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points (Liu, Ting, Zhou 2008)."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def path_length(n: Column) -> Column:
    """average_path() as an expression."""
    n = n.cast("double")
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)


def uniform(*parts: Column | str | int) -> Column:
    """A number from 0 to below 1 that depends on the parts alone: the first 52 bits of their SHA-256."""
    text = F.concat_ws("|", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each distinct family and feature vector once, with the number of its rows."""
    return rows.groupBy("family", *FEATURES).agg(F.count("*").alias("n_rows"))


def held_vectors(rows: DataFrame) -> DataFrame:
    """distinct_vectors(), computed once for the steps that read them."""
    return checkpointed(distinct_vectors(rows))


def held_baseline(rows: DataFrame) -> DataFrame:
    """Family and features of the baseline rows, computed once for the steps that read them."""
    return checkpointed(rows.select("family", *FEATURES))


def sent(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """What was found for each distinct vector, to be joined by items: broadcast while vectors are few, as a frequent vector's items would meet in one task."""
    return F.broadcast(found) if vectors.count() <= BROADCAST_VECTORS else found


def _draw(vectors: pd.DataFrame, most: int, key: list[int]) -> np.ndarray:
    """At most `most` rows, drawn without replacement from all rows that distinct vectors (with n_rows) stand for."""
    v = vectors.sort_values(FEATURES)
    ends = v["n_rows"].to_numpy(np.int64).cumsum()
    rows = np.arange(ends[-1]) if ends[-1] <= most else np.sort(np.random.default_rng(key).choice(ends[-1], most, replace=False))
    return v[FEATURES].to_numpy(float)[np.searchsorted(ends, rows, side="right")]


def background(baseline: DataFrame, most: int = BACKGROUND, seed: int = SEED) -> DataFrame:
    """Family and features of at most `most` baseline rows of each family, the same for the same rows.

    Each row has the same chance, so a vector comes as often as its share of the rows.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        family = pdf["family"].iloc[0]
        return pd.DataFrame(_draw(pdf, most, [seed, zlib.crc32(str(family).encode())]), columns=FEATURES).assign(family=family)[["family", *FEATURES]]

    return distinct_vectors(baseline).groupBy("family").applyInPandas(draw, "family string, " + ", ".join(f"{f} double" for f in FEATURES))


def _tree_samples(baseline: DataFrame, trees: int, sample: int, seed: int) -> DataFrame:
    """family, tree, x, w, n: each tree's vectors with their number of drawn rows, and the rows in all.

    Families of at most `sample` rows give all of them. Of larger ones a row is
    drawn from each of `sample` equal stretches of the rows in vector order, so
    none is drawn twice. Drawn positions meet their vectors in one sorted pass.
    """
    order = Window.partitionBy("family").orderBy(*FEATURES)  # a family has few distinct vectors
    vectors = distinct_vectors(baseline).select("family", "n_rows", F.array(*FEATURES).alias("x"), F.row_number().over(order).alias("no"), (F.sum("n_rows").over(order) - F.col("n_rows")).alias("at"), F.sum("n_rows").over(Window.partitionBy("family")).alias("total"))
    vectors = checkpointed(vectors)
    each_tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    whole = vectors.where(F.col("total") <= sample).select("family", each_tree, "x", F.col("n_rows").alias("w"), F.col("total").alias("n"))
    large = vectors.where(F.col("total") > sample)
    places = large.select("family", "total").distinct().select("family", "total", each_tree).select("*", F.explode(F.sequence(F.lit(0), F.lit(sample - 1))).alias("i"))
    at = F.floor((F.col("i") + uniform(seed, "draw", F.col("family"), F.col("tree"), F.col("i"))) * F.col("total") / sample).cast("long")
    both = large.select("family", "at", "no", F.lit(None).cast("int").alias("tree")).unionByName(places.select("family", at.alias("at"), F.lit(None).cast("int").alias("no"), "tree"))
    latest = Window.partitionBy("family").orderBy("at", F.col("no").asc_nulls_last())  # trees x sample rows and the vectors
    drawn = both.withColumn("no", F.last("no", ignorenulls=True).over(latest)).where("tree is not null").groupBy("family", "tree", "no").agg(F.count("*").alias("w"))
    return whole.unionByName(drawn.join(large.select("family", "no", "x"), ["family", "no"]).select("family", "tree", "x", "w", F.lit(sample).cast("long").alias("n")))


def _grow(family: str, tree: int, x: np.ndarray, w: np.ndarray, n: int, seed: int) -> list[tuple]:
    """Nodes of one tree as (node, feature, cut, path), from its drawn vectors and how often each one was drawn."""
    share = lambda *parts: int(hashlib.sha256("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:13], 16) / (1 << 52)
    limit, nodes, waiting = max(1, (n - 1).bit_length()), [], [(1, 0, np.arange(len(x)))]
    while waiting:
        node, depth, rows = waiting.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        differ = np.flatnonzero(high > low) if depth < limit else []
        if not len(differ):
            nodes.append((node, -1, 0.0, depth + average_path(int(w[rows].sum()))))
            continue
        f = int(differ[math.floor(share("feature", family, tree, node) * len(differ))])
        cut = float(low[f] + share("cut", family, tree, node) * (high[f] - low[f]))
        cut = cut if cut < high[f] else float(low[f])
        nodes.append((node, f, cut, 0.0))
        above = x[rows, f] > cut
        waiting += [(2 * node, depth + 1, rows[~above]), (2 * node + 1, depth + 1, rows[above])]
    return sorted(nodes)


def fit_forest(baseline: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """One row for each family and tree with its nodes as arrays: node, feature (-1: leaf), cut, path.

    Trees grow in parallel, each from at most `sample` rows. A node splits at a
    random place of a random feature among those that differ in it, both taken
    from hashes, so the same rows give the same trees anywhere. The root is node
    1, the children of k are 2k and 2k + 1; path is a leaf's depth and the mean
    path of the rows left in it.
    """

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        nodes = _grow(key[0], key[1], np.array(rows["x"].tolist()), rows["w"].to_numpy(), n, seed)
        node, feature, cut, path = map(list, zip(*nodes, strict=True))
        return pd.DataFrame({"family": [key[0]], "tree": [key[1]], "n": [n], "node": [node], "feature": [feature], "cut": [cut], "path": [path]})

    drawn = _tree_samples(baseline, trees, sample, seed)
    return checkpointed(drawn.groupBy("family", "tree").applyInPandas(grow, "family string, tree int, n int, node array<bigint>, feature array<int>, cut array<double>, path array<double>"))


def _paths(trees: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    """Mean path of each vector over all trees, which are walked together."""
    size = max(int(max(t)) for t in trees["node"]) + 1
    feature, cut, path = np.full((len(trees), size), -1), np.zeros((len(trees), size)), np.zeros((len(trees), size))
    for i, t in enumerate(trees.itertuples(index=False)):
        at = np.asarray(t.node)
        feature[i, at], cut[i, at], path[i, at] = t.feature, t.cut, t.path
    which, node = np.arange(len(trees))[None], np.ones((len(x), len(trees)), int)
    while (inner := (f := feature[which, node]) >= 0).any():
        above = np.take_along_axis(x, np.maximum(f, 0), axis=1) > cut[which, node]
        node = np.where(inner, 2 * node + above, node)
    return path[which, node].mean(axis=1)


def _raw_scores(trees: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    return -(2.0 ** (-_paths(trees, x) / max(average_path(int(trees["n"].iloc[0])), 1e-9)))


def raw_scores(vectors: DataFrame, forest: DataFrame) -> DataFrame:
    """Adds raw, from -1 (odd) to 0, to vectors (family and features) of families with a forest.

    Every vector walks down all trees of its family at once, one join with the
    nodes of a level for each step. The nodes are broadcast if the forest is as
    small as one of a few families.
    """
    nodes = forest.select("family", "tree", "n", F.explode(F.arrays_zip("node", "feature", "cut", "path")).alias("s")).select("family", "tree", "n", "s.*")
    small = forest.count() <= BROADCAST_TREES
    at = vectors.withColumn("x", F.array(*FEATURES)).join(F.broadcast(forest.select("family", "tree", "n")) if small else forest.select("family", "tree", "n"), "family")
    at = at.withColumns({"node": F.lit(1).cast("long"), "path": F.lit(None).cast("double")})
    deepest = forest.agg(F.max(F.array_max("node"))).first()[0] or 1
    for depth in range(int(deepest).bit_length()):
        level = nodes.where(F.col("node").between(1 << depth, (1 << depth + 1) - 1)).select("family", "tree", "node", F.col("feature").alias("_f"), "cut", F.col("path").alias("_p"))
        at = at.join(F.broadcast(level) if small else level, ["family", "tree", "node"], "left")
        down = 2 * F.col("node") + (F.get("x", F.col("_f")) > F.col("cut")).cast("long")
        at = at.withColumn("path", F.coalesce("path", F.when(F.col("_f") < 0, F.col("_p")))).withColumn("node", F.when(F.col("_f") >= 0, down).otherwise(F.lit(0).cast("long"))).drop("_f", "_p", "cut")
    scale = F.greatest(path_length(F.first("n")), F.lit(1e-9))
    return at.groupBy(*vectors.columns).agg((-F.pow(F.lit(2.0), -F.avg("path") / scale)).alias("raw"))


def model_scores(vectors: DataFrame, baseline: DataFrame, forest: DataFrame) -> DataFrame:
    """Family, features and model_score of distinct vectors: the raw score less the 1st percentile over all baseline rows; 0 without a forest."""
    rows = vectors.select("family", *FEATURES, F.lit(0).cast("long").alias("n_rows"), F.lit(True).alias("asked")).unionByName(distinct_vectors(baseline).withColumn("asked", F.lit(False)))
    every = rows.groupBy("family", *FEATURES).agg(F.sum("n_rows").alias("n_base"), F.max("asked").alias("asked"))
    scored = checkpointed(raw_scores(every, forest))
    offset = scored.where("n_base > 0").groupBy("family").agg(F.percentile("raw", CONTAMINATION, F.col("n_base")).alias("offset"))
    own = scored.where("asked").join(offset, "family").select("family", *FEATURES, (F.round(F.col("raw") - F.col("offset"), 12) + 0.0).alias("model_score"))  # the order of sums does not show
    without = vectors.select("family", *FEATURES).join(forest.select("family").distinct(), "family", "left_anti").withColumn("model_score", F.lit(0.0))
    return own.unionByName(without)


def rule_attribution(vectors: DataFrame, baseline: DataFrame) -> DataFrame:
    """M10, rule part: weight times (value less baseline mean) for each penalised feature; the Shapley values of a linear score."""
    means = baseline.groupBy("family").agg(*(F.avg(f).alias(f"m_{f}") for f in WEIGHTS))
    parts = F.array(*(F.struct(F.lit(f).alias("feature"), (F.round(F.lit(w) * (F.col(f) - F.col(f"m_{f}")), 6) + 0.0).alias("phi")) for f, w in WEIGHTS.items()))
    return vectors.join(means, "family").select("family", *FEATURES, F.explode(parts).alias("p")).select("family", *FEATURES, "p.feature", "p.phi")


def attribution(vectors: DataFrame, baseline: DataFrame, forest: DataFrame, permutations: int = 8, seed: int = SEED, most: int = 5) -> DataFrame:
    """The `most` largest Shapley values of the final score for each distinct vector, by permutations of the features.

    For every permutation the features are set one after another from the
    background to the vector; the mean change of the score at a feature's turn
    is its value. The values of a vector add up to its score less the
    background's mean. base_score and total_phi come along for checking.
    """
    base = background(baseline).select("family", *FEATURES, F.lit(True).alias("is_base"))
    both = vectors.select("family", *FEATURES, F.lit(False).alias("is_base")).unionByName(base)
    weights = np.array([WEIGHTS.get(f, 0.0) for f in FEATURES])

    def explain(key: tuple, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        columns = ["family", "vector_no", *FEATURES, "feature", "phi", "rank", "score", "base_score", "total_phi"]
        own, bg = (rows[rows["is_base"] == b][FEATURES].to_numpy(float) for b in (False, True))
        if not len(own) or not len(bg):
            return pd.DataFrame(columns=columns)

        def f(x: np.ndarray) -> np.ndarray:
            unique, inverse = np.unique(x, axis=0, return_inverse=True)
            model = _raw_scores(trees, unique) if len(trees) else np.zeros(len(unique))
            return (model + unique @ weights)[inverse.ravel()]

        rng, out = np.random.default_rng(seed), []
        orders = [rng.permutation(len(FEATURES)) for _ in range(permutations)]
        base_score = float(f(bg).mean())
        for no, v in enumerate(own):
            phi = np.zeros(len(FEATURES))
            for order in orders:
                states = [bg.copy()]
                for i in order:
                    states.append(states[-1].copy())
                    states[-1][:, i] = v[i]
                means = f(np.concatenate(states)).reshape(len(states), -1).mean(axis=1)
                phi[order] += np.diff(means) / permutations
            for rank, i in enumerate(np.argsort(-np.abs(phi), kind="stable")[:most], 1):
                out.append((key[0], no, *v, FEATURES[i], phi[i], rank, float(f(v[None])[0]), base_score, phi.sum()))
        return pd.DataFrame(out, columns=columns)

    schema = "family string, vector_no int, " + ", ".join(f"{f} double" for f in FEATURES) + ", feature string, phi double, rank int, score double, base_score double, total_phi double"
    return both.groupBy("family").cogroup(forest.groupBy("family")).applyInPandas(explain, schema)
