import numpy as np
import pandas as pd
import pytest

from estatelens.operators.ordering import dense_index, first_per_key
from estatelens.operators.quantiles import medians, moments, summarize
from pyspark.sql import functions as F


def frame(seed=0, n=3000):
    rng = np.random.default_rng(seed)
    # One group holds a third of the rows, another is nearly all copies, one key is null.
    g = np.where(rng.random(n) < 1 / 3, "hot", rng.choice(["a", "b", "copies"], n)).astype(object)
    x = np.round(rng.normal(0, 50, n), 2)
    x[g == "copies"] = np.where(rng.random((g == "copies").sum()) < 0.95, 7.0, x[g == "copies"])
    g[rng.random(n) < 0.05] = None
    x[rng.random(n) < 0.02] = 0.0
    return pd.DataFrame({"g": g, "x": np.where(rng.random(n) < 0.03, np.nan, x)})


@pytest.mark.parametrize("parts", [1, 7])
def test_matches_numpy(spark, parts):
    pdf = frame()
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(parts)
    probs = {"p0": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in summarize(df, ["g"], "x", probs).collect()}
    for key, part in pdf.groupby("g", dropna=False):
        x = part["x"].dropna()
        row = got[None if pd.isna(key) else key]
        assert row["count"] == len(x)
        assert row["mean"] == pytest.approx(x.mean()) and row["std"] == pytest.approx(x.std())
        assert (row["min"], row["max"]) == (x.min(), x.max())
        for name, p in probs.items():
            assert row[name] == pytest.approx(x.quantile(p))
    whole = summarize(df, [], "x", {"median": 0.5}).first()
    assert whole["median"] == pytest.approx(pdf["x"].median())


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert summarize(df, ["g"], "x", {"median": 0.5}).count() == 0


def test_large_group_table_stays_distributed(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("g"), (F.col("id") * 1.5).alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = summarize(df, ["g"], "x", {"median": 0.5})
        plan = found._jdf.queryExecution().executedPlan().toString()
        per_part = found.groupBy(F.spark_partition_id()).count().collect()
        got = {r.g: r.median for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Groups lie in several partitions, and nothing is gathered in one on the way.
    assert len(per_part) > 1 and "SinglePartition" not in plan
    assert got == {g: float(np.median([1.5 * i for i in range(500) if i % 50 == g])) for g in range(50)}


def test_dense_index(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 1000).alias("v"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 4).cast("string")).alias("g"))
    rows = dense_index(df, ["v"], by=["g"]).toPandas()
    for _, part in rows.groupby("g"):
        part = part.sort_values("v")
        assert part["row_index"].tolist() == list(range(1, len(part) + 1))


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), (None, 5, "z"), (None, 4, "y")], "k string, o int, v string")
    got = {(r.k, r.o, r.v) for r in first_per_key(df, ["k"], [F.col("o")]).collect()}
    assert got == {("a", 1, None), (None, 4, "y")}


def test_narrow_ranges_are_split_before_they_are_ranked(spark, monkeypatch):
    """Longitudes, seconds since 1970 and mostly equal values: no ranked bucket of different values is over the limit."""
    from estatelens.operators import quantiles

    rng = np.random.default_rng(4)
    n = 6000
    values = {
        "longitude": rng.uniform(103.6, 104.0, n), "seconds": 1.7e9 + rng.integers(0, 10**6, n).astype(float),
        "west": -rng.uniform(103.6, 103.60001, n), "copies": np.where(rng.random(n) < 0.97, 5.0, 5.0 + rng.random(n) * 1e-9),
    }
    pdf = pd.concat([pd.DataFrame({"g": g if g != "west" else None, "x": x}) for g, x in values.items()])
    written = []
    keep = quantiles.materialize
    monkeypatch.setattr(quantiles, "RANKED_ROWS", 40)
    monkeypatch.setattr(quantiles, "PARTS", 64)
    monkeypatch.setattr(quantiles, "materialize", lambda df: written.append(keep(df)) or written[-1])
    probs = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in summarize(spark.createDataFrame(pdf).repartition(5), ["g"], "x", probs).collect()}
    for key, x in values.items():
        row = got[None if key == "west" else key]
        assert row["count"] == n and (row["min"], row["max"]) == (x.min(), x.max())
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(x, p), rel=1e-15)
    assert len(written) > 2
    assert written[0].where("__n > 40 AND __lo < __hi").count() and not written[-1].where("__n > 40 AND __lo < __hi").count()


def test_medians_of_any_doubles(spark):
    """Medians found by bits: signs, ends of the range, ties, nulls and NaN."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(501) * 10.0 ** rng.integers(-300, 300, 501), [0.0, -0.0, 5e-324, 1e308] * 5])
    rows = [(float(v), float(-abs(v)), None if k % 3 else 7.5, float("nan"), k % 4) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int").repartition(3)
    want = {"a": np.median(x), "b": np.median(-abs(x)), "c": 7.5, "e": np.median(np.arange(len(x)) % 4)}
    assert medians(df, ["a", "b", "c", "d", "e"]) == want
    assert medians(df.where("e > 9"), ["a", "b"]) == {}


def test_moments_read_the_rows_once(spark):
    """Mean and deviation of many columns are one scan without a shuffle of rows, nulls filled."""
    rng = np.random.default_rng(5)
    x = 1e6 + rng.standard_normal((5000, 3))
    df = spark.createDataFrame([(*map(float, r), None) for r in x], "a double, b double, c double, d double").repartition(4)
    got = moments(df, list("abcd"), {"a": 0.0, "b": 0.0, "c": 0.0, "d": 2.5})
    for k, c in enumerate("abc"):
        assert abs(got[c][0] - x[:, k].mean()) < 1e-8 and abs(got[c][1] / x[:, k].std() - 1) < 1e-9
    assert got["d"] == (2.5, 0.0)
