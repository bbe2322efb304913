import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import by, rows
from tradewind.functions import bands, numeric, ranking, temporal
from tradewind.functions.durable import durable


def test_total_ignores_order_and_counts_nothing_as_zero(spark):
    values = [0.1, 0.2, 0.3, 1e6, -1e6, None]
    one = spark.createDataFrame([(v,) for v in values], "v double").agg(numeric.total("v")).first()[0]
    other = spark.createDataFrame([(v,) for v in reversed(values)], "v double").agg(numeric.total("v")).first()[0]
    assert one == other == 0.6
    empty = spark.createDataFrame([], "v double").agg(numeric.total("v"), numeric.mean("v")).first()
    assert tuple(empty) == (0.0, None)


def test_rounding_and_shares_follow_pandas(spark):
    pairs = [(1, 8), (5, 2000), (245, 2000), (1, 0), (None, 3)]
    df = spark.createDataFrame(pairs, "a long, b long").select(
        numeric.percent("a", "b").alias("p"), numeric.percent("a", "b", 2).alias("p2"), numeric.ratio0("a", "b").alias("r")
    )
    got = [tuple(r) for r in df.collect()]
    assert got == [(12.5, 12.5, 0.125), (0.2, 0.25, 0.0025), (12.2, 12.25, 0.1225), (None, None, 0.0), (None, None, 0.0)]


def test_parse_utc(spark):
    texts = ["2022-03-21 05:50:00", "2022-03-21 05:50:00 UTC", "2022-03-21 05:50:00+02:00", "2022-03-21", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(temporal.parse_utc("t")).collect()]
    at = dt.datetime(2022, 3, 21, 5, 50)
    assert got == [at, at, at - dt.timedelta(hours=2), dt.datetime(2022, 3, 21), None, None]


def test_parse_utc_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.createDataFrame([("2022-03-21 05:50:00",), ("2022-03-21 05:50:00+02:00",)], "t string")
        got = [str(r[0]) for r in df.select(temporal.parse_utc("t").cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == ["2022-03-21 05:50:00", "2022-03-21 03:50:00"]


def test_whole_days_round_down(spark):
    df = spark.sql(
        "select timestamp_ntz'2023-12-31 00:00:00' as a, timestamp_ntz'2023-12-31 01:00:00' as b, timestamp_ntz'2023-12-29 23:59:59' as c"
    )
    assert tuple(df.select(temporal.whole_days("a", "b"), temporal.whole_days("a", "c")).first()) == (-1, 1)


def test_sale_price_bands_are_left_closed(spark):
    prices = [0.0, 24.99, 25.0, 50.0, 100.0, 199.99, 200.0, 1e9, -1.0, None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in prices], "p double").select(bands.sale_price_band("p")).collect()]
    assert got == ["<$25", "<$25", "$25-50", "$50-100", "$100-200", "$100-200", "$200+", "$200+", None, None]


def test_right_closed_bands(spark):
    prices = [0.0, 0.01, 25.0, 500.0, 500.01, None]
    got = [
        r[0]
        for r in spark.createDataFrame([(p,) for p in prices], "p double")
        .select(bands.band("p", bands.RECOGNIZED_PRICE_BANDS))
        .collect()
    ]
    assert got == [None, "<$25", "<$25", "$200-500", "$500+", None]
    ages = [0, 24, 25, 64, 65, 200, 201, -1]
    got = [
        r[0]
        for r in spark.createDataFrame([(a,) for a in ages], "a int")
        .select(bands.band("a", bands.AGE_BANDS, include_lowest=True))
        .collect()
    ]
    assert got == ["<=24", "<=24", "25-34", "55-64", "65+", "65+", None, None]


def test_first_match_skips_null_conditions(spark):
    df = spark.createDataFrame([(None,), (1,), (5,)], "v int")
    label = bands.first_match([(F.col("v") > 3, "high"), (F.col("v") > 0, "low")], "none")
    assert [r[0] for r in df.select(label).collect()] == ["none", "low", "high"]


@pytest.mark.parametrize("n, ties", [(1, 1), (3, 2), (7, 7), (1000, 3), (5000, 5000)])
def test_percentiles_match_numpy(spark, n, ties):
    rng = np.random.default_rng(n)
    values = rng.integers(0, ties, n) * 1.25
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    row = ranking.percentile_of(df, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q100": 1.0}).first()
    expected = np.percentile(values, [25, 50, 75, 90, 100])
    assert np.allclose([row[c] for c in ("q25", "q50", "q75", "q90", "q100")], expected)


def test_percentile_of_nothing_is_null(spark):
    assert ranking.percentile_of(spark.createDataFrame([], "v double"), "v", {"q": 0.5}).collect()[0][0] is None


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 13, 999, 4000])
def test_quintiles_match_the_ranked_cut(spark, n):
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"user": rng.permutation(n), "once": 1, "few": rng.integers(0, 3, n), "many": rng.normal(size=n)})
    got = ranking.quintiles(durable(spark.createDataFrame(frame)), "user", ["once", "few", "many"]).toPandas()
    got = got.sort_values("user").reset_index(drop=True)
    for metric in ("once", "few", "many"):
        rank = got[metric].rank(method="first", pct=True)
        expected = pd.cut(rank, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], labels=[1, 2, 3, 4, 5], include_lowest=True)
        assert (got[f"{metric}_quintile"] == expected.astype(int)).all(), metric


def test_order_statistics_use_weights(spark):
    values = spark.createDataFrame([("a", k, w) for k, w in [(1.0, 5), (2.0, 1), (3.0, 4)]], "series string, key double, weight long")
    ranks = {"first": F.lit(1), "fifth": F.lit(5), "sixth": F.lit(6), "last": F.col("n"), "outside": F.col("n") + 1}
    assert by(ranking.order_statistics(values, ranks), "label", "key") == {"first": 1.0, "fifth": 1.0, "sixth": 2.0, "last": 3.0}


def test_two_step_edge_search(spark):
    edges = sorted(np.random.default_rng(1).choice(10_000, 100, replace=False).tolist())
    df = spark.createDataFrame([(edges,)], "keys array<long>").select(*ranking.edge_columns(F.col("keys")))
    df = df.withColumn("v", F.explode(F.sequence(F.lit(-1), F.lit(10_001), F.lit(37)).cast("array<long>")))
    for v, found in df.select("v", ranking.slice_of(F.col("v"))).collect():
        assert found == sum(e < v for e in edges)


@pytest.mark.parametrize("target", [7, 300, 6000])
def test_large_groups_are_split_and_small_ones_are_not(spark, target):
    hot = [("hot", i * i) for i in range(20_000)]
    warm = [("warm", i) for i in range(600)]  # one in a hundred rows
    cold = [(f"s{i % 20_000}", i) for i in range(40_000)]
    df = spark.createDataFrame(pd.DataFrame(hot + warm + cold, columns=["g", "k"]))
    sliced = ranking.split_long_groups(df, "g", "k", "k", target)
    sizes = sliced.groupBy("g", "_slice").count().collect()
    for group, n in (("hot", 20_000), ("warm", 600)):
        found = [r["count"] for r in sizes if r["g"] == group]
        assert sum(found) == n and max(found) <= target and len(found) >= n / target
    assert all(r["_slice"] == [] for r in sizes if r["g"] not in ("hot", "warm"))
    # Slices keep the order of the key.
    spans = sliced.where("g = 'hot'").groupBy("_slice").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("_slice").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))


def test_copies_of_one_key_are_left_whole(spark):
    df = spark.createDataFrame([("a", 5, i) for i in range(100)] + [("a", 6, 100)], "g string, k int, id int")
    sizes = ranking.split_long_groups(df, "g", "k", "id", 10).groupBy("_slice").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 100]


@pytest.mark.parametrize("n, target", [(20_000, 50), (20_000, 3000), (500, 1)])
def test_wanted_slices_are_cut_until_they_are_small(spark, n, target):
    keys = np.sort(np.random.default_rng(n).choice(10**9, n, replace=False)) ** 2
    frame = pd.DataFrame({"series": "a", "key": keys, "weight": 1 + np.arange(n) % 3})
    values = durable(spark.createDataFrame(pd.concat([frame, frame.assign(series="b", key=-keys)])).repartition(4, "key"))
    ranks = {str(p): F.ceil(F.col("n") * p / 10) for p in range(1, 11)}
    slices = ranking.narrow_slices(values, ranks, "series", "key", "weight", target)
    assert len(slices) == 20 and max(s["rows"] for s in slices) <= target
    found = ranking.order_statistics(values, ranks, target=target).collect()
    whole = {"a": np.repeat(keys, frame["weight"]), "b": -np.repeat(keys, frame["weight"])[::-1]}
    assert len(found) == 20
    for r in found:
        assert r.key == whole[r.series][math.ceil(len(whole[r.series]) * int(r.label) / 10) - 1]


def test_durable_uses_the_configured_folder(spark):
    df = durable(spark.range(10))
    assert rows(df) == [(i,) for i in range(10)]
    assert spark.sparkContext.getCheckpointDir()


def test_totals_past_nine_billion_do_not_depend_on_the_partitions(spark):
    from decimal import Decimal

    cents = F.pmod(F.xxhash64("id"), F.lit(25_000_000))
    amounts = spark.range(200_000).select((cents / 100).alias("v"), F.xxhash64("id", F.lit(1)).alias("h"), cents.alias("cents"))
    exact = Decimal(amounts.agg(F.sum("cents")).first()[0]) / 100
    assert exact > 9_007_199_254
    found = {amounts.repartition(n, "h").agg(numeric.total("v")).first()[0] for n in (1, 3, 7, 16)}
    assert found == {float(exact)}
