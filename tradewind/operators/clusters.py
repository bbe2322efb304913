"""Customer clusters: by rule and by k-means."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.bands import first_match
from tradewind.functions.durable import durable
from tradewind.functions.numeric import mean
from tradewind.functions.ranking import percentile_of
from tradewind.functions.reshape import with_row
from tradewind.params import NO_PURCHASE_SEGMENT

CLUSTER_FEATURES = ("Recency", "Monetary", "aov", "category_diversity", "return_rate_pct")
PROFILE = ("Recency", "Frequency", "Monetary", "aov", "category_diversity", "return_rate_pct")
CANDIDATE_COUNTS = range(2, 8)
#: Sums of features are held in whole parts of this size.
UNIT = float(1 << 24)
#: Rows that are measured against all centers at a time, and rows of a task in a pass.
BLOCK_ROWS = 1024
TASK_ROWS = 1 << 18

# The summing function travels with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Recency of users without a purchase, and cluster names from the most to the least valuable.
NEVER = 9999
CLUSTER_NAMES = (
    "High-Value Loyal",
    "Selective Buyers",
    "At-Risk High Value",
    "Recent But Inactive",
    "Occasional Spenders",
    "Low-Value Browsers",
    "No Valid Purchase",
)


def enriched_rfm(fact: DataFrame, dim_users: DataFrame, dim_products: DataFrame) -> DataFrame:
    """RFM per user with order value, profit and the number of distinct categories bought."""
    category = dim_products.select("product_id", "category").distinct()
    diversity = (
        fact.where((F.col("is_recognized_revenue") == 1) & F.col("user_id").isNotNull())
        .select("user_id", "product_id")
        .distinct()
        .join(category, "product_id")
        .groupBy("user_id")
        .agg(F.countDistinct("category").alias("category_diversity"))
    )
    users = dim_users.select(
        "user_id",
        F.coalesce("Recency", F.lit(NEVER)).cast("bigint").alias("Recency"),
        F.coalesce("Frequency", F.lit(0)).alias("Frequency"),
        F.coalesce("Monetary", F.lit(0.0)).alias("Monetary"),
        F.coalesce("return_rate_pct", F.lit(0.0)).alias("return_rate_pct"),
        F.coalesce("rfm_segment", F.lit(NO_PURCHASE_SEGMENT)).alias("rfm_segment"),
    )
    return users.join(diversity, "user_id", "left").select(
        *users.columns,
        F.coalesce(F.try_divide("Monetary", "Frequency"), F.lit(0.0)).alias("aov"),
        F.col("Monetary").alias("profit_per_customer"),
        F.coalesce("category_diversity", F.lit(0)).alias("category_diversity"),
    )


def rule_clusters(enriched: DataFrame) -> DataFrame:
    """Clusters by ordered rules with the top tenth and quarter of all users' value; ids follow the names' order."""
    enriched = durable(enriched)
    cuts = percentile_of(enriched, "Monetary", {"q90": 0.9, "q75": 0.75})
    recency, frequency, value = F.col("Recency"), F.col("Frequency"), F.col("Monetary")
    # Rules and names.
    label = first_match(
        [
            (frequency == 0, "No Valid Purchase"),
            ((frequency >= 3) & (value >= F.col("_cuts.q90")), "High-Value Loyal"),
            ((frequency >= 2) & (recency <= 180), "Selective Buyers"),
            ((value >= F.col("_cuts.q75")) & (recency > 365), "At-Risk High Value"),
            (recency > 730, "Low-Value Browsers"),
            (frequency == 1, "Occasional Spenders"),
        ],
        "Recent But Inactive",
    )
    labelled = with_row(enriched, cuts, "_cuts").withColumn("cluster_label", label).drop("_cuts")
    names = labelled.agg(F.sort_array(F.collect_set("cluster_label")).alias("names")).scalar()  # seven at most
    return labelled.withColumn("cluster", (F.array_position(names, F.col("cluster_label")) - 1).cast("int"))


def cluster_profile(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster", "cluster_label").agg(*[mean(c).alias(c) for c in PROFILE])


def standardize(enriched: DataFrame, features: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """Adds the array `scaled` of features with mean 0 and population deviation 1; a constant feature is only centred."""
    stats = enriched.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in features], *[F.stddev_pop(c).alias(f"{c}_sd") for c in features]
    )

    def centred(c: str) -> Column:
        deviation = F.col(f"_stats.{c}_sd")
        return (F.col(c) - F.col(f"_stats.{c}_mean")) / F.when(deviation == 0, 1.0).otherwise(deviation)

    return with_row(enriched, stats, "_stats").withColumn("scaled", F.array(*map(centred, features))).drop("_stats")


@dataclass(frozen=True)
class Fit:
    """One start of one cluster count: its centers, within-cluster sum of squares, rounds, and whether it came to rest."""

    k: int
    start: int
    centers: np.ndarray
    cost: float
    rounds: int
    converged: bool


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centers), each summed feature by feature: the same for a row in whatever batch it comes."""
    out = np.zeros((len(x), len(centers)))
    for i in range(centers.shape[1]):
        out += (x[:, i : i + 1] - centers[:, i]) ** 2
    return out


def starting_centers(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Rows of the sample, each drawn with a chance in proportion to its squared distance from those already drawn."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.integers(len(sample))][None]
    while len(centers) < k:
        far = _distances(sample, centers).min(axis=1)
        if not far.any():  # fewer distinct rows than centers
            far = np.ones(len(sample))
        centers = np.vstack([centers, sample[rng.choice(len(sample), p=far / far.sum())]])
    return centers


def packed(vectors: DataFrame) -> DataFrame:
    """The arrays `scaled` as blocks of `BLOCK_ROWS` rows, dealt evenly to tasks: a pass then has no cost per row but its sums.

    A task gets about `TASK_ROWS` rows, which bounds what its Python process holds.
    """
    size = BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            width = len(flat) // max(1, len(batch) - batch.column(0).null_count)
            blocks = [flat[at : at + size * width].tobytes() for at in range(0, len(flat), size * max(1, width))]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["block"])

    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, vectors.count() // TASK_ROWS + 1)
    return vectors.select("scaled").repartition(tasks).mapInArrow(run, "block binary")


def _nearest_sums(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (run, cluster) and exact sums (run, cluster, feature and squared distance) of `centers` (run, cluster, feature).

    Whole parts are split into two limbs, whose sums over a block are whole numbers that a double holds.
    """
    low = int(UNIT) - 1
    runs, k, width = centers.shape
    away, step = np.zeros((runs, k, len(x))), np.empty((runs, k, len(x)))
    for i in range(width):
        np.subtract(x[:, i], centers[:, :, i, None], out=step)
        np.multiply(step, step, out=step)
        away += step
    best, own = away[:, 0].copy(), np.zeros((runs, len(x)), np.int64)
    for c in range(1, k):
        np.copyto(own, c, where=away[:, c] < best)
        np.minimum(best, away[:, c], out=best)
    member = (own[:, None] == np.arange(k)[:, None]).astype(float)

    def added(parts: np.ndarray) -> np.ndarray:
        high, rest = (np.matmul(member, limb.astype(float)).astype(np.int64) for limb in (parts >> 24, parts & low))
        return (high << 24) + rest

    features = added(np.rint(x * UNIT).astype(np.int64))
    squares = added(np.rint(best * UNIT).astype(np.int64)[:, :, None])
    return member.sum(axis=2).astype(np.int64), np.concatenate([features, squares], axis=2)


def _sum_up(blocks: DataFrame, runs: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, np.ndarray, float]]:
    """(run, cluster) to the number, sums and squared distances of the rows nearest to each center of each run.

    One pass over the `packed` blocks serves all runs. A task adds up whole numbers, parts of `UNIT`, so sums are exact and
    the order in which tasks are merged or retried does not matter. The driver gets one row per center.
    """
    width = runs[0].shape[1]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    alike = {}  # runs with the same number of centers are measured together
    for nr, r in enumerate(runs):
        alike.setdefault(len(r), []).append(nr)
    groups = [
        (np.concatenate([np.arange(bounds[nr], bounds[nr + 1]) for nr in numbers]), np.stack([runs[nr] for nr in numbers]))
        for numbers in alike.values()
    ]
    total = int(bounds[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(total, np.int64)
        sums = np.zeros((total, width + 1), np.int64)
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer(), float).reshape(-1, width)
                for at, centers in groups:
                    rows, parts = _nearest_sums(x, centers)
                    n[at] += rows.reshape(-1)
                    sums[at] += parts.reshape(-1, width + 1)
        columns = [pa.array(np.arange(total)), pa.array(n), *[pa.array(c) for c in sums.T]]
        yield pa.RecordBatch.from_arrays(columns, names=["center", "n", *[f"s{i}" for i in range(width + 1)]])

    schema = "center long, n long, " + ", ".join(f"s{i} long" for i in range(width + 1))
    names = ["n", *[f"s{i}" for i in range(width + 1)]]
    parts = blocks.mapInArrow(run, schema)
    out = {}
    for r in parts.groupBy("center").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).collect():
        nr = int(np.searchsorted(bounds, r["center"], "right")) - 1
        sums = np.array([float(r[f"s{i}"]) for i in range(width + 1)]) / UNIT
        out[nr, r["center"] - int(bounds[nr])] = (int(r["n"]), sums[:-1], sums[-1])
    return out


def fit_kmeans(
    vectors: DataFrame,
    counts: Sequence[int],
    seed: int = 42,
    restarts: int = 10,
    max_iter: int = 100,
    tolerance: float = 1e-4,
    start_rows: int = 4096,
) -> list[Fit]:
    """The best of `restarts` starts for each cluster count. `vectors` has the array `scaled` and should be durable.

    Every round moves the centers of all counts and starts that are not yet at rest in one pass over all rows; a last pass
    takes the costs. A start is at rest when its centers move by no more than `tolerance` in squares; `converged` says
    whether it was within `max_iter` rounds. First centers are drawn from the `start_rows` rows of smallest hash, which
    bounds what the driver holds; an empty cluster keeps its center.
    """
    picked = vectors.select("scaled").orderBy(F.xxhash64("scaled"), "scaled").limit(start_rows).collect()
    if not picked:
        raise ValueError("no rows to cluster")
    sample = np.array([r["scaled"] for r in picked], float)
    keys = [(k, start) for k in counts for start in range(restarts)]
    centers = {(k, start): starting_centers(sample, k, seed + start) for k, start in keys}
    rounds, moving = dict.fromkeys(keys, 0), list(keys)
    blocks = durable(packed(vectors))
    for _ in range(max_iter):
        if not moving:
            break
        found = _sum_up(blocks, [centers[key] for key in moving])
        still = []
        for nr, key in enumerate(moving):
            new = centers[key].copy()
            for c in range(key[0]):
                n, sums, _ = found[nr, c]
                if n:
                    new[c] = sums / n
            if ((new - centers[key]) ** 2).sum() > tolerance:
                still.append(key)
            centers[key], rounds[key] = new, rounds[key] + 1
        moving = still
    found = _sum_up(blocks, [centers[key] for key in keys])
    costs = {key: float(sum(found[nr, c][2] for c in range(key[0]))) for nr, key in enumerate(keys)}
    best = {k: min((costs[k, start], start) for start in range(restarts))[1] for k in counts}
    return [Fit(k, best[k], centers[k, best[k]], costs[k, best[k]], rounds[k, best[k]], (k, best[k]) not in moving) for k in counts]


def elbow(costs: Sequence[float]) -> int:
    """Count after the smallest second difference of the costs for 2, 3, ... clusters, kept between 2 and 7."""
    if len(costs) < 3:
        return 6
    second = [costs[i + 2] - 2 * costs[i + 1] + costs[i] for i in range(len(costs) - 2)]
    return max(2, min(second.index(min(second)) + 3, 7))


def _chosen(vectors: DataFrame, fits: Sequence[Fit]) -> tuple[int, DataFrame]:
    chosen = elbow([fit.cost for fit in fits])
    listed = [(fit.k, fit.cost, fit.rounds, fit.converged) for fit in fits]
    table = vectors.sparkSession.createDataFrame(listed, "k int, inertia double, rounds int, converged boolean")
    return chosen, table.withColumn("chosen", F.col("k") == chosen)


def choose_cluster_count(vectors: DataFrame, restarts: int = 10) -> tuple[int, DataFrame]:
    """The chosen count, and the cost of every candidate count with its rounds and whether it came to rest."""
    return _chosen(vectors, fit_kmeans(vectors, CANDIDATE_COUNTS, restarts=restarts))


def nearest(vector: str, centers: np.ndarray) -> Column:
    """Number of the nearest center; the first of equally near ones."""
    cells = [
        F.struct(
            sum(((F.col(vector)[i] - float(v)) * (F.col(vector)[i] - float(v)) for i, v in enumerate(center)), F.lit(0.0)).alias("d"),
            F.lit(nr).alias("nr"),
        )
        for nr, center in enumerate(centers)
    ]
    return F.array_min(F.array(*cells))["nr"]


def label_clusters(profile: DataFrame) -> DataFrame:
    """Names by mean value, highest first, then by recency. `profile` has one row per cluster."""
    rank = F.row_number().over(Window.orderBy(F.col("Monetary").desc(), "Recency"))
    names = F.array(*[F.lit(n) for n in CLUSTER_NAMES])
    return profile.withColumn("cluster_label", F.element_at(names, (rank - 1) % len(CLUSTER_NAMES) + 1))


def kmeans_clusters(enriched: DataFrame, k: int | None = None, restarts: int = 10) -> DataFrame:
    """Users with cluster id and name; without `k` the count is chosen by `choose_cluster_count`."""
    vectors = durable(standardize(durable(enriched)))
    fits = fit_kmeans(vectors, CANDIDATE_COUNTS if k is None else [k], restarts=restarts)
    if k is None:
        k, _ = _chosen(vectors, fits)
    fit = next(fit for fit in fits if fit.k == k)
    assigned = vectors.withColumn("cluster", nearest("scaled", fit.centers)).drop("scaled")
    profile = assigned.groupBy("cluster").agg(mean("Monetary").alias("Monetary"), mean("Recency").alias("Recency"))
    names = label_clusters(profile).select("cluster", "cluster_label")
    return assigned.join(F.broadcast(names), "cluster")  # k rows


def users_with_clusters(dim_users: DataFrame, clustered: DataFrame) -> DataFrame:
    return dim_users.join(clustered.select("user_id", "cluster_label"), "user_id", "left")
