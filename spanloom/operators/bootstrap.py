"""Cluster bootstrap under shared weights, drawn where the clusters lie: no row of a cluster comes to the driver.

Each draw resamples C clusters C times. Its counts follow a multinomial law, which is drawn down a binary tree over the
numbered clusters: a node's count is split between its halves by a binomial whose uniform is a hash of (seed, draw, level,
node). So a task that holds some leaves works out their counts alone, and the counts of all tasks add up to C.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.order import running
from spanloom.session import stash

#: Draws of a batch; clusters of a task at most, and of one product; batches of a task; partial sums that one task adds up.
BATCH, LEAF, CHUNK, SLAB, FAN_IN = 250, 1 << 12, 1 << 10, 8, 16
#: Odd factors that spread the keys, and those of the mixing of 64-bit numbers.
KEYS = {"seed": 0x9E3779B97F4A7C15, "draw": 0xC2B2AE3D27D4EB4F, "level": 0x165667B19E3779F9, "node": 0xD6E8FEB86659FD93}
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))

#: Statistics of summed features: (draws, features) to (draws, values).
Stat = Callable[[np.ndarray], np.ndarray]


def uniforms(seed: int, draws: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
    """(draws, nodes) numbers in [0, 1)."""
    at = {k: np.uint64(v) for k, v in KEYS.items()}
    with np.errstate(over="ignore"):
        z = np.uint64(seed % 2**64) * at["seed"] + draws.astype(np.uint64)[:, None] * at["draw"] + np.uint64(level) * at["level"] + nodes.astype(np.uint64)[None, :] * at["node"]
        for shift, factor in MIX:
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 32)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """From a table, and by Stirling's series where that is exact to the last digits."""
    x = np.maximum(n, 16).astype(float) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(n < 32, _FACTORIALS[np.minimum(n, 31)], series)


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The binomial count of each n and p whose distribution function first reaches u; n and u (draws, nodes), p (nodes)."""
    p = np.broadcast_to(p, n.shape)
    sure = (p <= 0) | (p >= 1) | (n == 0)
    q = np.where(sure, 0.5, p)
    # what lies ten deviations below the mean is less than any step of u
    k = np.maximum(0, np.floor(n * q - 10 * np.sqrt(n * q * (1 - q)) - 1)).astype(np.int64)
    mass = np.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * np.log(q) + (n - k) * np.log1p(-q))
    reached = mass.copy()
    odds = q / (1 - q)
    while (go := (reached < u) & (k < n) & ~sure).any():
        mass = np.where(go, mass * (n - k) / (k + 1) * odds, mass)
        k = k + go
        reached = reached + np.where(go, mass, 0)
    return np.where(sure, np.where(p >= 1, n, 0), k)


def start(node: np.ndarray | int, level: int, clusters: int) -> np.ndarray | int:
    """The first cluster of a node: a level cuts the clusters into 2^level runs."""
    return node * clusters >> level


def depth(clusters: int, size: int) -> int:
    """The level whose nodes hold so many clusters at most."""
    level = 0
    while -(-clusters >> level) > size:
        level += 1
    return level


def counts(clusters: int, leaf: int, level: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """(draws, clusters of the leaf): how often each draw takes each cluster of node `leaf` of a level."""
    n = np.full((len(draws), 1), clusters, dtype=np.int64)
    last = depth(clusters, 1)
    nodes = np.zeros(1, dtype=np.int64)
    for at in range(last):
        low, mid, high = (start(x, y, clusters) for x, y in ((nodes, at), (2 * nodes + 1, at + 1), (nodes + 1, at)))
        left = binomial(n, (mid - low) / np.maximum(1, high - low), uniforms(seed, draws, at, nodes))
        if at < level:  # on the way to the leaf
            right = leaf >> (level - at - 1) & 1
            n, nodes = (n - left if right else left), 2 * nodes + right
        else:
            n = np.stack([left, n - left], axis=2).reshape(len(draws), -1)
            nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).reshape(-1)
    return n[:, start(nodes + 1, last, clusters) > start(nodes, last, clusters)]


def _sums(t: pd.DataFrame, leaf: int, level: int, clusters: int, slab: int, width: int, n_boot: int, seed: int) -> pd.DataFrame:
    """Weighted sums of the features of one leaf: a row a batch, system and run."""
    first = int(start(leaf, level, clusters))
    size = int(start(leaf + 1, level, clusters)) - first
    parts = []
    for (system, run), x in t.sort_values("rank").groupby(["system", "run"], sort=True):
        row, column, value = (x[c].to_numpy() for c in ("rank", "feature", "value"))
        used, column = np.unique(column, return_inverse=True)
        parts.append((system, run, row - first, column, value, used))
    out = []
    batches = range(slab * SLAB, min((slab + 1) * SLAB, -(-n_boot // BATCH)))
    for batch in [*([-1] if slab == 0 else []), *batches]:
        draws = np.arange(batch * BATCH, min((batch + 1) * BATCH, n_boot))
        w = np.ones((1, size)) if batch < 0 else counts(clusters, leaf, level, draws, seed).astype(float)
        for system, run, row, column, value, used in parts:
            total = np.zeros((len(w), len(used)))
            for lo in range(0, size, CHUNK):
                a, b = np.searchsorted(row, [lo, lo + CHUNK])
                if a < b:
                    x = np.zeros((min(CHUNK, size - lo), len(used)))
                    np.add.at(x, (row[a:b] - lo, column[a:b]), value[a:b])
                    total += w[:, lo:lo + CHUNK] @ x
            whole = np.zeros((len(w), width))
            whole[:, used] = total
            out.append((batch, system, run, leaf, whole.tobytes()))
    return pd.DataFrame(out, columns=["batch", "system", "run", "part", "sums"])


def drawn(features: DataFrame, width: int, stat: Stat, names: tuple[str, ...], n_boot: int = 2000, seed: int = 0, clusters: DataFrame | None = None, leaf: int = LEAF) -> DataFrame:
    """(system, draw, name, value): statistics of each system under the same weights, means over its runs; draw -1 is the sample.

    features: (system, run, cluster, feature, value) with feature in 0..width-1, summed where they repeat. clusters: all of
    them (cluster), those without a row count as zeros; without it each system and run must have the same clusters.

    A leaf of at most `leaf` clusters is one task for SLAB batches. What it sends on is n_boot by width doubles a system and
    run, so all leaves send clusters / leaf times that; sums are added FAN_IN at a time. Whole numbers stay exact, so results
    don't depend on how rows are dealt.
    """
    spark = features.sparkSession
    have = features.select("cluster").distinct()
    ids = stash(running((have if clusters is None else clusters.select("cluster").distinct()), [F.col("cluster")]), "clusters")
    n = ids.count()
    if not n:
        return spark.createDataFrame([], "system string, draw long, name string, value double")
    f = features.groupBy("system", "run", "cluster", "feature").agg(F.sum("value").cast("double").alias("value"))
    if clusters is None:
        short = features.groupBy("system", "run").agg(F.count_distinct("cluster").alias("k")).where(F.col("k") < n).first()
        if short:
            raise ValueError(f"{short.system} is scored on {short.k} of {n} clusters")
    elif lost := have.join(ids, "cluster", "left_anti").first():
        raise ValueError(f"scored on other clusters, such as {lost.cluster}")
    level = depth(n, leaf)
    slabs = -(-(-(-n_boot // BATCH)) // SLAB)
    rows = f.join(ids, "cluster").select(F.col("system").cast("string"), F.col("run").cast("long"), "rank", F.col("feature").cast("int"), "value", F.expr(f"((rank + 1) * {2**level} - 1) div {n}").alias("leaf"), F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"))
    schema = "batch long, system string, run long, part long, sums binary"
    sums = rows.groupBy("leaf", "slab").applyInPandas(lambda k, t: _sums(t, int(k[0]), level, n, int(k[1]), width, n_boot, seed), schema)

    def add(t: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(t["sums"].iloc[0]).copy()
        for x in t["sums"].iloc[1:]:
            total += np.frombuffer(x)
        return pd.DataFrame([(t["batch"].iloc[0], t["system"].iloc[0], t["run"].iloc[0], t["part"].iloc[0] // FAN_IN, total.tobytes())], columns=["batch", "system", "run", "part", "sums"])

    parts = 2**level
    while parts > 1:
        sums = stash(sums, "bootstrap").groupBy("batch", "system", "run", F.expr(f"part div {FAN_IN}").alias("to")).applyInPandas(add, schema)
        parts = -(-parts // FAN_IN)

    def values(batches):
        for t in batches:
            for r in t.itertuples():
                v = stat(np.frombuffer(r.sums).reshape(-1, width))
                draw = np.array([-1]) if r.batch < 0 else r.batch * BATCH + np.arange(len(v))
                yield pd.DataFrame({"system": r.system, "run": r.run, "draw": np.repeat(draw, len(names)), "name": list(names) * len(v), "value": v.reshape(-1)})

    each = sums.mapInPandas(values, "system string, run long, draw long, name string, value double")
    return stash(each.groupBy("system", "draw", "name").agg(F.avg("value").alias("value")), "draws")


_TWO_SIDED, _ONE_SIDED = (0.025, 0.975), (0.05, 0.95)


def _bounds(column: str) -> list:
    """Bounds of the draws that are defined."""
    v = F.when((F.col("draw") >= 0) & ~F.isnan(column), F.col(column))
    q = [(*_TWO_SIDED, "lower_95", "upper_95"), (*_ONE_SIDED, "one_sided_lower_95", "one_sided_upper_95")]
    return [F.percentile(v, F.lit(p)).alias(name) for lo, hi, a, b in q for p, name in ((lo, a), (hi, b))]


def intervals(draws: DataFrame) -> DataFrame:
    """(system, name, value, lower_95, upper_95, one_sided_lower_95, one_sided_upper_95)."""
    point = F.max(F.when(F.col("draw") == -1, F.col("value"))).alias("value")
    return draws.groupBy("system", "name").agg(point, *_bounds("value"))


def differences(draws: DataFrame, baseline: str) -> DataFrame:
    """(system, name, value, baseline, difference, bounds, p_value) of each other system against the baseline, draw by draw.

    p_value is two-sided, with one added to both tails.
    """
    base = draws.where(F.col("system") == baseline).select("draw", "name", F.col("value").alias("base"))
    d = draws.where(F.col("system") != baseline).join(base, ["draw", "name"]).withColumn("diff", F.col("value") - F.col("base"))
    point = [F.max(F.when(F.col("draw") == -1, F.col(c))).alias(n) for c, n in (("value", "value"), ("base", "baseline"), ("diff", "difference"))]
    again, n = F.col("draw") >= 0, F.count_if(F.col("draw") >= 0)
    tails = [(F.count_if(again & x) + 1) / (n + 1) for x in (F.col("diff") <= 0, F.col("diff") >= 0)]
    return d.groupBy("system", "name").agg(*point, *_bounds("diff"), F.least(F.lit(1.0), 2 * F.least(*tails)).alias("p_value"))


# Statistics ----------------------------------------------------------------------------------------------------------


def histogram_features(hist: DataFrame, system: str, run: int = 0) -> DataFrame:
    """Features of (cluster, bin, n_pii, n_non): bins of PII, then those of the rest. Width 2 * BINS of functions.prob."""
    from spanloom.functions.prob import BINS

    cells = F.explode(F.array(F.struct(F.col("bin").alias("feature"), F.col("n_pii").alias("value")), F.struct((F.col("bin") + BINS).alias("feature"), F.col("n_non").alias("value"))))
    return hist.select("cluster", cells.alias("c")).where("c.value <> 0").select(F.lit(system).alias("system"), F.lit(run).alias("run"), "cluster", "c.feature", "c.value")


def f1_features(counts_by: DataFrame, labels: list[str], system: str, run: int = 0) -> DataFrame:
    """Features of (cluster, label, tp, fp, fn): three a label of the list, other labels are left out. Width 3 * len(labels)."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int") - 1
    cells = F.explode(F.array(*[F.struct((at * 3 + i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(("tp", "fp", "fn"))]))
    return counts_by.where(F.col("label").isin(labels)).select("cluster", cells.alias("c")).select(F.lit(system).alias("system"), F.lit(run).alias("run"), "cluster", "c.feature", "c.value")


def mean_features(rows: DataFrame, system: str, run: int = 0) -> DataFrame:
    """Features of (cluster, value): sum and number. Width 2."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(("s", "k"))]))
    d = rows.groupBy("cluster").agg(F.sum("value").alias("s"), F.count("value").alias("k")).select("cluster", cells.alias("c"))
    return d.select(F.lit(system).alias("system"), F.lit(run).alias("run"), "cluster", "c.feature", "c.value")


#: Equal-width bins of the score, three features each, and two of the Brier score.
CALIBRATION_BINS = 15
CALIBRATION = 3 * CALIBRATION_BINS + 2


def calibration_features(rows: DataFrame, system: str, run: int = 0) -> DataFrame:
    """Features of (cluster, score, target): rows, scores and targets by bin, and squared errors. Width CALIBRATION."""
    b = F.least(F.floor(F.col("score") * CALIBRATION_BINS), F.lit(CALIBRATION_BINS - 1)).cast("int") * 3
    own = [(b, F.lit(1.0)), (b + 1, F.col("score")), (b + 2, F.col("target")), (F.lit(CALIBRATION - 2), F.pow(F.col("score") - F.col("target"), 2)), (F.lit(CALIBRATION - 1), F.lit(1.0))]
    cells = F.explode(F.array(*[F.struct(i.alias("feature"), v.cast("double").alias("value")) for i, v in own]))
    return rows.select("cluster", cells.alias("c")).select(F.lit(system).alias("system"), F.lit(run).alias("run"), "cluster", "c.feature", "c.value")


def calibration(sums: np.ndarray) -> np.ndarray:
    """(draws, 2): equal-width calibration error and Brier score."""
    n = sums[:, -1]
    _, p, y = np.moveaxis(sums[:, :-2].reshape(len(sums), -1, 3), 2, 0)
    both = np.stack([np.abs(p - y).sum(1), sums[:, -2]], axis=1)
    return np.divide(both, n[:, None], out=np.full(both.shape, np.nan), where=n[:, None] > 0)


def pauc(sums: np.ndarray) -> np.ndarray:
    from spanloom.operators.stats import pauc_of

    half = sums.shape[1] // 2
    return pauc_of(sums[:, :half], sums[:, half:])[:, None]


def f1(sums: np.ndarray) -> np.ndarray:
    """(draws, 2): micro F1, and macro F1 over the labels that have gold in the draw."""
    tp, fp, fn = np.moveaxis(sums.reshape(len(sums), -1, 3), 2, 0)
    micro = 2 * tp.sum(1) / np.maximum(1, (2 * tp + fp + fn).sum(1))
    each = 2 * tp / np.maximum(1, 2 * tp + fp + fn)
    there = tp + fn > 0
    return np.stack([micro, (each * there).sum(1) / np.maximum(1, there.sum(1))], axis=1)


def mean(sums: np.ndarray) -> np.ndarray:
    return np.divide(sums[:, :1], sums[:, 1:], out=np.full((len(sums), 1), np.nan), where=sums[:, 1:] > 0)
