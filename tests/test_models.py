"""Models against dense numpy fits of the same rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from estatelens.functions.tails import normal_two_sided, student_quantile_975, student_two_sided
from estatelens.operators import absorb as A, blocks as B, coefficients as C, gram as L, leastsquares as Q, models as M, rdd as R


def sales(seed=0, n=1500):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"txn_id": range(n)})
    for c in M.FULL_NUMERIC:
        f[c] = rng.normal(5, 2, n)
    f[M.EXPOSURE] = (f["good_school_count_1km"] > 5).astype(float)
    f["town"] = np.where(rng.random(n) < 0.4, "A", rng.choice(list("BCD"), n))
    f["flat_type"], f["flat_model"] = rng.choice(["t1", "t2"], n), rng.choice(["m1", "m2", "m3"], n)
    f["month_dt"] = pd.to_datetime("2020-01-01") + pd.to_timedelta(0, "D")
    f["month_period"] = rng.choice(["2020-01", "2020-02", "2020-03"], n)
    f[M.TARGET] = 12 + 0.03 * f["floor_area_sqm"] + 0.05 * f[M.EXPOSURE] + 0.1 * (f["town"] == "A") + rng.normal(0, 0.1, n)
    f["resale_price"] = np.exp(f[M.TARGET])
    f["parks_within_5min_walk"] = np.where(rng.random(n) < 0.05, np.nan, f["parks_within_5min_walk"])
    return f.drop(columns="month_dt")


def to_spark(spark, f):
    """The rows with null for NaN, typed by the frame's columns."""
    kinds = {"f": "double", "i": "long", "O": "string"}
    schema = ", ".join(f"{c} {kinds[t.kind]}" for c, t in f.dtypes.items())
    return spark.createDataFrame(f.astype(object).where(f.notna(), None).to_numpy().tolist(), schema)


def dense(f, numeric, fields):
    x = [np.ones(len(f))] + [f[c].to_numpy() for c in numeric]
    for c in fields:
        x += [(f[c] == v).to_numpy(float) for v in sorted(f[c].unique())[1:]]
    return np.column_stack(x)


def ols(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e, rank = y - x @ b, np.linalg.matrix_rank(x)
    cov = np.linalg.pinv(x.T @ x) * (e @ e) / (len(y) - rank)
    return b, np.sqrt(np.diag(cov))


def test_ols_table(spark):
    f = sales()
    numeric = [*M.STRUCTURE, M.EXPOSURE, "parks_within_5min_walk"]
    got = M.ols_table(to_spark(spark, f).repartition(5), numeric, ["town", "month_period"]).toPandas().set_index("term")
    g = f.dropna(subset=numeric)
    b, se = ols(dense(g, numeric, ["town", "month_period"]), g[M.TARGET].to_numpy())
    assert got["coef"].to_numpy() == pytest.approx(b, rel=1e-7)
    assert got["std_err"].to_numpy() == pytest.approx(se, rel=1e-7)
    assert list(got.index[-2:]) == ["C(month_period)[T.2020-02]", "C(month_period)[T.2020-03]"]


def test_town_premiums(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_PER_CHUNK", 200)
    monkeypatch.setattr(L, "SLICE_NUMBERS", 5_000)
    f = sales(1)
    f.loc[f["town"] == "D", "good_school_count_1km"] = -1.0
    f.loc[f["town"] == "C", "floor_area_sqm"] = np.nan
    got, skipped = M.town_premiums(to_spark(spark, f), min_rows=100, min_share=0.05)
    got = got.toPandas().set_index("town")
    assert {r.town: r.reason for r in skipped.collect()} == {"C": "fit_failed", "D": "below_threshold"} and set(got.index) == {"A", "B"}
    numeric = ["good_school_count_1km", *M.STRUCTURE, *M.AMENITIES]
    for town, row in got.iterrows():
        g = f[f["town"] == town]
        h = g.dropna(subset=numeric)
        b, se = ols(dense(h, numeric, ["flat_type", "flat_model", "month_period"]), h[M.TARGET].to_numpy())
        assert row["rows"] == len(h)
        assert (row["coef_log_points"], row["std_err"]) == pytest.approx((b[1], se[1]), rel=1e-6)
        assert row["town_median_resale_price"] == pytest.approx(g["resale_price"].median())


def test_nested_trace_uses_each_specs_complete_rows(spark):
    f = sales(2)
    got = M.nested_trace(to_spark(spark, f)).toPandas().set_index("specification")
    numeric, fields = [], []
    for name, cols, more in M.NESTED:
        numeric += cols
        fields += more
        g = f.dropna(subset=numeric)
        b, se = ols(dense(g, numeric, fields), g[M.TARGET].to_numpy())
        assert got.loc[name, "rows"] == len(g)
        assert (got.loc[name, "coef_log_points"], got.loc[name, "std_err"]) == pytest.approx((b[1], se[1]), rel=1e-6)


def prepared(f, numeric):
    x = f[numeric].fillna(f[numeric].median())
    z = (x - x.mean()) / x.std(ddof=0)
    hot = [(f[c] == v).to_numpy(float) for c in M.CATEGORIES for v in sorted(f[c].unique())]
    return np.column_stack([z.to_numpy(), *hot])


def test_ridge_weighted_and_predictions(spark):
    f = sales(3)
    f["w"] = np.random.default_rng(1).uniform(0.5, 3, len(f))
    numeric = list(M.REDUCED_NUMERIC)
    z, y, w = prepared(f, numeric), f[M.TARGET].to_numpy(), f["w"].to_numpy()
    for weight in (None, "w"):
        k = w if weight else np.ones(len(y))
        zc, yc = z - np.average(z, axis=0, weights=k), y - np.average(y, weights=k)
        b = np.linalg.solve(zc.T @ (zc * k[:, None]) + np.eye(z.shape[1]), zc.T @ (yc * k))
        fitted = np.average(y, weights=k) + (z - np.average(z, axis=0, weights=k)) @ b
        df = to_spark(spark, f)
        model = M.fit_ridge(df, numeric, weight=weight)
        got = model.predict(df).orderBy("txn_id").toPandas()["predicted_log_price"].to_numpy()
        assert got == pytest.approx(fitted, abs=1e-9)
    unseen = to_spark(spark, f.head(1)).withColumn("town", F.lit("nowhere"))
    assert model.predict(unseen).first()["predicted_log_price"] is not None


def test_penalised_fits_meet_their_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    y = x[:, 0] * 2 - x[:, 3] + rng.normal(size=400)
    xc, yc = x - x.mean(0), y - y.mean()
    c = L.Sums(400, xc.T @ xc, xc.T @ yc, yc @ yc)
    pairs = [(0.01, 1.0), (0.3, 1.0), (0.1, 0.3)]
    for (alpha, ratio), b in zip(pairs, M.elastic_nets([c], pairs)[0].T):
        slope = xc.T @ (yc - xc @ b) / 400 - alpha * (1 - ratio) * b
        on = b != 0
        assert slope[on] == pytest.approx(alpha * ratio * np.sign(b[on]), abs=1e-5)
        assert (np.abs(slope[~on]) <= alpha * ratio + 1e-5).all()


def test_folds_are_contiguous(spark):
    df = spark.range(23).withColumn("k", F.col("id") * 7 % 23)
    got = M.fold_of(df, ["k"], 5).orderBy("k").toPandas()["fold"].tolist()
    assert got == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4


def test_vif_two_columns_and_collinear():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    x[:, 1] += x[:, 0]
    g = x.T @ x
    r2 = g[0, 1] ** 2 / (g[0, 0] * g[1, 1])
    assert M.vif_scores(g) == pytest.approx([1 / (1 - r2)] * 2)
    y = np.column_stack([x, x.sum(1)])
    assert np.isinf(M.vif_scores(y.T @ y)).all()


def test_rebalance_sizes(spark):
    f = sales(5)
    f["floor_area_sqm"] = np.round(f["floor_area_sqm"])
    df = to_spark(spark, f)
    edges, sizes, target = M.bin_sizes(df, "floor_area_sqm", 8, 0.75)
    cut = pd.qcut(f["floor_area_sqm"], 8, duplicates="drop").value_counts().sort_index()
    assert [sizes[b] for b in sorted(sizes)] == cut.tolist() and target == cut.quantile(0.75)
    got = M.rebalance(df, "floor_area_sqm", 8, 0.75, ["txn_id"], 42)
    after = {r.floor_area_bin: r["count"] for r in got.groupBy("floor_area_bin").count().collect()}
    assert after == {b: max(n, int(target)) for b, n in sizes.items()}
    again = M.rebalance(df.repartition(3), "floor_area_sqm", 8, 0.75, ["txn_id"], 42)
    assert got.groupBy().sum("txn_id").first() == again.groupBy().sum("txn_id").first()


def boundary(seed=0, n=1600):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({
        "boundary_school_name": np.where(rng.random(n) < 0.4, "HOT", rng.choice(["X", "Y", "Z"], n)),
        "signed_distance_m": np.round(rng.uniform(-300, 300, n)),
    })
    f["is_good_school"] = f["boundary_school_name"].isin(["HOT", "Y"])
    for c in M.STRUCTURE:
        f[c] = rng.normal(10, 3, n)
    for c, v in zip(R.CONTROL_FIELDS, ("AB", "CD", "EF", "GHI")):
        f[c] = rng.choice(list(v), n)
    f[M.TARGET] = 13 + 0.05 * (f["signed_distance_m"] <= 0) + 0.01 * f["floor_area_sqm"] + rng.normal(0, 0.2, n)
    f["resale_price"] = np.exp(f[M.TARGET])
    f["address_key"] = "k"
    return f


def wls_hc1(x, y, w):
    r = np.sqrt(w)
    xw, yw = x * r[:, None], y * r
    inverse = np.linalg.pinv(xw.T @ xw)
    b = inverse @ xw.T @ yw
    e = yw - xw @ b
    n, k = len(y), np.linalg.matrix_rank(xw)
    cov = inverse @ (xw.T @ (xw * (e**2)[:, None])) @ inverse * n / (n - k)
    mean = np.average(y, weights=w)
    return b, np.sqrt(np.diag(cov)), 1 - (e @ e) / (w @ (y - mean) ** 2)


def jump_columns(g):
    t, km = (g["signed_distance_m"] <= 0).to_numpy(float), g["signed_distance_m"].to_numpy() / 1000
    return t, km, t * km


@pytest.mark.parametrize("chunk", [100, 250_000])
def test_rdd_sweep(spark, monkeypatch, chunk):
    monkeypatch.setattr(L.chunk_sizes, "__defaults__", (chunk,))
    monkeypatch.setattr(L.as_chunks, "__defaults__", (chunk,))
    f = boundary()
    results, skipped = R.rdd_sweep(spark.createDataFrame(f).repartition(6), (100, 300), min_total=150, min_side=40)
    got = {(r.boundary_school_name, r.bandwidth_m, r.specification): r for r in results.collect()}
    seen = 0
    for school, s in f.groupby("boundary_school_name"):
        for h in (100, 300):
            g = s[s["signed_distance_m"].abs() <= h]
            t, km, tk = jump_columns(g)
            if len(g) < 150 or t.sum() < 40 or (1 - t).sum() < 40:
                continue
            base = np.column_stack([np.ones(len(g)), t, km, tk])
            more = np.column_stack([base, dense(g, M.STRUCTURE, R.CONTROL_FIELDS)[:, 1:]])
            w = np.clip(1 - g["signed_distance_m"].abs() / h, 0, None).to_numpy()
            for spec, x in (("uncontrolled", base), ("controlled", more)):
                b, se, r2 = wls_hc1(x, g[M.TARGET].to_numpy(), w)
                r = got[school, float(h), spec]
                seen += 1
                assert (r.cutoff_coef_log_points, r.cutoff_std_err, r.r_squared) == pytest.approx((b[1], se[1], r2), rel=1e-6)
                assert r.cutoff_p_value == pytest.approx(math.erfc(abs(b[1] / se[1]) / math.sqrt(2)), rel=1e-5)
                assert r.local_median_resale_price == pytest.approx(g["resale_price"].median())
    assert seen == len(got) > 4
    assert skipped.count() == 8 - seen // 2 and skipped.count() > 0


def test_rdd_interaction(spark):
    f = boundary(1)
    got = {(r.bandwidth_m, r.specification): r for r in R.rdd_interaction(spark.createDataFrame(f), (100, 300)).collect()}
    for h in (100, 300):
        g = f[f["signed_distance_m"].abs() <= h]
        t, km, tk = jump_columns(g)
        good = g["is_good_school"].to_numpy(float)
        base = np.column_stack([np.ones(len(g)), t, km, tk, t * good, km * good, tk * good, dense(g, [], ["boundary_school_name"])[:, 1:]])
        more = np.column_stack([base, dense(g, M.STRUCTURE, R.CONTROL_FIELDS)[:, 1:]])
        w = np.clip(1 - g["signed_distance_m"].abs() / h, 0, None).to_numpy()
        for spec, x in (("uncontrolled", base), ("controlled", more)):
            b, se, r2 = wls_hc1(x, g[M.TARGET].to_numpy(), w)
            r = got[float(h), spec]
            want = (b[1], se[1], b[4], se[4], r2)
            assert (r.non_good_cutoff_coef_log_points, r.non_good_cutoff_std_err, r.good_school_diff_coef_log_points,
                    r.good_school_diff_std_err, r.r_squared) == pytest.approx(want, rel=1e-6)


def test_absorbed_ols_equals_a_dense_fit(spark):
    f = sales(6, 700)
    f["town"] = [f"t{k % 30}" for k in range(len(f))]
    f["block"] = [f"b{k % 7}" for k in range(len(f))]
    f.loc[f["town"] < "t3", "block"] = "apart"  # two parts that no row connects
    numeric = ["floor_area_sqm", "storey_mid", "school_count_1km"]
    y = f[M.TARGET].to_numpy()
    for fields in (["town"], ["town", "block"]):
        table, effects = A.ols_absorbed(to_spark(spark, f), numeric, fields, M.TARGET)
        x = np.column_stack([f[numeric].to_numpy(), *[(f[c] == v).to_numpy(float) for c in fields for v in f[c].unique()]])
        inverse = np.linalg.pinv(x.T @ x)
        b = inverse @ x.T @ y
        e = y - x @ b
        free = len(y) - np.linalg.matrix_rank(x)
        se = np.sqrt(np.diag(inverse) * (e @ e) / free)
        for r, coef, err in zip(table.collect(), b, se):
            assert (r.coef, r.std_err) == pytest.approx((coef, err), rel=1e-6)
            assert r.p_value == pytest.approx(student_two_sided(coef / err, free), rel=1e-4)
        found = {(r.field, r.level): r.effect for r in effects.collect()}
        fitted = found[None, "Intercept"] + f[numeric].to_numpy() @ b[:3] + sum(f[c].map(lambda v, c=c: found[c, v]).to_numpy() for c in fields)
        assert fitted == pytest.approx(x @ b, abs=1e-6)


def test_absorbed_ridge_equals_the_dense_one(spark, monkeypatch):
    f = sales(7, 900)
    f["w"] = np.random.default_rng(1).uniform(0.5, 3, len(f))
    df, numeric = to_spark(spark, f), list(M.REDUCED_NUMERIC)[:4]
    dense_fit = M.fit_ridge(df, numeric, weight="w")
    monkeypatch.setattr(M, "is_wide", lambda *_: True)
    wide = M.fit_ridge(df, numeric, weight="w")
    assert isinstance(wide, A.WideModel)
    unseen = df.limit(1).withColumn("town", F.lit("nowhere")).withColumn("txn_id", F.lit(-1))
    both = df.unionByName(unseen)
    want = dense_fit.predict(both).orderBy("txn_id").toPandas()["predicted_log_price"].to_numpy()
    assert wide.predict(both).orderBy("txn_id").toPandas()["predicted_log_price"].to_numpy() == pytest.approx(want, abs=1e-7)
    a, b = ({r.feature: r.coefficient for r in m.importance(spark).collect()} for m in (dense_fit, wide))
    assert sorted(a) == sorted(b) and [a[k] for k in sorted(a)] == pytest.approx([b[k] for k in sorted(b)], abs=1e-7)


def test_a_hundred_thousand_levels(spark):
    n, levels = 220_000, 100_000
    k = F.col("id")
    x = F.sin(k * 1.7) * 3 + F.pmod(k, F.lit(levels)) / 1e4
    df = spark.range(n).select((F.pmod(k, F.lit(levels))).cast("string").alias("block"), x.alias("x"), F.cos(k * 0.9).alias("noise"))
    df = df.withColumn("y", 2.5 * F.col("x") + F.sin(F.col("block").cast("double") * 3) * 5 + F.col("noise"))
    assert L.is_wide(df, ["block"])
    got = M.ols_table(df, ["x"], ["block"], "y").first()
    f = df.toPandas()
    own = f[["x", "y"]] - f.groupby("block")[["x", "y"]].transform("mean")
    assert got.coef == pytest.approx((own.x @ own.y) / (own.x @ own.x), rel=1e-8)


def least_length(f, numeric, fields):
    """Terms, coefficients and errors by a pseudo-inverse of the whole design with columns of unit length."""
    x, names = dense(f, numeric, fields), ["Intercept", *numeric, *dummy_names(f, fields)]
    shift, scale, p = f[numeric].mean().to_numpy(), f[numeric].std(ddof=0).to_numpy(), len(numeric)
    x[:, 1:p + 1] = (x[:, 1:p + 1] - shift) / scale
    y = f[M.TARGET].to_numpy() - f[M.TARGET].mean()
    norms = np.sqrt((x * x).sum(axis=0))
    values, vectors = np.linalg.eigh(x.T @ x / np.outer(norms, norms))
    on = values > 1e-10
    inverse = (vectors[:, on] / values[on]) @ vectors[:, on].T / np.outer(norms, norms)
    b, back = inverse @ x.T @ y, np.eye(len(names))
    e = y - x @ b
    back[1:p + 1, 1:p + 1] = np.diag(1 / scale)
    back[0, 1:p + 1] = -shift / scale
    b = back @ b
    b[0] += f[M.TARGET].mean()
    return names, b, np.sqrt(np.diag(back @ inverse @ back.T) * (e @ e) / (len(y) - on.sum())), len(y) - on.sum()


def check_least_squares(table, f, numeric, fields):
    names, b, se, free = least_length(f, numeric, fields)
    got = {r.term: r for r in table.collect()}
    assert sorted(got) == sorted(names)
    for name, coef, err in zip(names, b, se):
        r = got[name]
        assert (r.coef, r.std_err, r.t) == pytest.approx((coef, err, coef / err), rel=1e-6, abs=1e-8)
        assert r.p_value == pytest.approx(student_two_sided(coef / err, free), rel=1e-4, abs=1e-9)
        reach = student_quantile_975(free) * err
        assert (r.ci_low, r.ci_high) == pytest.approx((coef - reach, coef + reach), rel=1e-6, abs=1e-7)


def crowded(seed, n):
    f = sales(seed, n)
    f["parks_within_5min_walk"] = f["parks_within_5min_walk"].fillna(0.0)
    f["town"] = [f"t{k * k % 23:02d}" for k in range(n)]
    f["flat_model"] = [f"m{k * 7 % 19:02d}" for k in range(n)]
    return f


def test_least_squares_has_every_term_at_any_number_of_levels(spark, monkeypatch):
    """The limit of dense designs neither leaves terms out nor is an error."""
    f, numeric, fields = crowded(11, 600), ["floor_area_sqm", "storey_mid", "school_count_1km"], ["flat_type", "town", "flat_model"]
    want = M.ols_table(to_spark(spark, f), numeric, fields).collect()
    monkeypatch.setattr(L, "MAX_TERMS", 10)
    got = M.ols_table(to_spark(spark, f).repartition(5), numeric, fields)
    assert [r.term for r in got.collect()] == [r.term for r in want]
    check_least_squares(got, f, numeric, fields)


def test_least_squares_of_more_levels_than_a_dense_design_holds(spark):
    n, levels = 9_000, 4_500
    rng = np.random.default_rng(12)
    f = pd.DataFrame({"block": [f"{k % levels:04d}" for k in range(n)], "x": rng.normal(size=n)})
    f["y"] = 2 * f["x"] + 0.001 * f["block"].astype(int) + rng.normal(size=n)
    assert L.is_wide(to_spark(spark, f), ["block"])
    got = {r.term: r for r in M.ols_table(to_spark(spark, f), ["x"], ["block"], "y").collect()}
    assert len(got) == levels + 1
    by = f.groupby("block")[["x", "y"]]
    own, mean = f[["x", "y"]] - by.transform("mean"), by.mean()
    sxx = own.x @ own.x
    slope = own.x @ own.y / sxx
    variance = ((own.y - slope * own.x) ** 2).sum() / (n - levels - 1)
    effect = mean.y - slope * mean.x
    assert (got["x"].coef, got["x"].std_err) == pytest.approx((slope, math.sqrt(variance / sxx)), rel=1e-9)
    assert (got["Intercept"].coef, got["Intercept"].std_err) == pytest.approx((effect.iloc[0], math.sqrt(variance * (1 / 2 + mean.x.iloc[0] ** 2 / sxx))), rel=1e-8)
    for name in ("0001", "2500", "4499"):
        r = got[f"C(block)[T.{name}]"]
        err = math.sqrt(variance * (1 + (mean.x[name] - mean.x.iloc[0]) ** 2 / sxx))
        assert (r.coef, r.std_err) == pytest.approx((effect[name] - effect.iloc[0], err), rel=1e-8)


@pytest.mark.parametrize("block", [512, 18])
def test_least_squares_in_blocks(spark, monkeypatch, block):
    """Blocks give what one matrix gives: full rank, and with columns and categories that depend on each other."""
    monkeypatch.setattr(B, "BLOCK", block)
    if block < 512:
        monkeypatch.setattr(Q, "LEVELS_AT_ONCE", 5)
        monkeypatch.setattr(Q, "CELLS_AT_ONCE", 8)
    f = crowded(13, 500)
    check_least_squares(M.ols_table(to_spark(spark, f), ["storey_mid", "floor_area_sqm"], ["town", "flat_model"]), f, ["storey_mid", "floor_area_sqm"], ["town", "flat_model"])
    f["lease_age_years"] = f["storey_mid"] * 2 + 1
    f["flat_type"] = f["town"].str[:2] + (f["town"].str[-1].astype(int) // 4).astype(str)
    numeric, fields = ["storey_mid", "floor_area_sqm", "lease_age_years"], ["flat_type", "flat_model", "town"]
    check_least_squares(M.ols_table(to_spark(spark, f).repartition(3), numeric, fields), f, numeric, fields)


def test_effects_that_do_not_settle_raise(spark, monkeypatch):
    monkeypatch.setattr(A, "MOST_ROUNDS", 1)
    with pytest.raises(ArithmeticError):
        A.ols_absorbed(to_spark(spark, sales(8, 200)), ["storey_mid"], ["town", "flat_type"], M.TARGET)


def dummy_names(g, fields):
    return [f"C({c})[T.{v}]" for c in fields for v in sorted(g[c].unique())[1:]]


def check_table(rows, names, x, y, w):
    """All terms with estimate, HC1 error, z, p and interval, against a dense fit."""
    b, se, _ = wls_hc1(x, y, w)
    got = {r.term: r for r in rows}
    assert sorted(got) == sorted(names)
    for name, coef, err in zip(names, b, se):
        r = got[name]
        assert (r.coef, r.std_err, r.z) == pytest.approx((coef, err, coef / err), rel=1e-5, abs=1e-9)
        assert r.p_value == pytest.approx(math.erfc(abs(coef / err) / math.sqrt(2)), rel=1e-3, abs=1e-12)
        assert (r.ci_low, r.ci_high) == pytest.approx((coef - 1.959963985 * err, coef + 1.959963985 * err), rel=1e-5, abs=1e-7)


@pytest.mark.parametrize("chunk", [100, 250_000])
def test_sweep_coefficients(spark, monkeypatch, chunk):
    monkeypatch.setattr(L.as_chunks, "__defaults__", (chunk,))
    f = boundary(2)
    f.loc[f["boundary_school_name"] == "X", "town"] = "B"  # one level only: no dummy
    table = C.sweep_coefficients(spark.createDataFrame(f).repartition(5), (100, 300), min_total=150, min_side=40)
    got = {}
    for r in table.collect():
        got.setdefault((r.boundary_school_name, r.school_group, r.bandwidth_m, r.specification), []).append(r)
    seen = 0
    for school, s in f.groupby("boundary_school_name"):
        for h in (100, 300):
            g = s[(s["signed_distance_m"].abs() <= h)]
            t, km, tk = jump_columns(g)
            if len(g) < 150 or t.sum() < 40 or (1 - t).sum() < 40:
                continue
            w = np.clip(1 - g["signed_distance_m"].abs() / h, 0, None).to_numpy()
            base, names = np.column_stack([np.ones(len(g)), t, km, tk]), ["Intercept", "treat", "running_km", "treat:running_km"]
            more = np.column_stack([base, dense(g, M.STRUCTURE, R.CONTROL_FIELDS)[:, 1:]])
            group = "good" if g["is_good_school"].iloc[0] else "non_good"
            check_table(got[school, group, float(h), "uncontrolled"], names, base, g[M.TARGET].to_numpy(), w)
            check_table(got[school, group, float(h), "controlled"], [*names, *M.STRUCTURE, *dummy_names(g, R.CONTROL_FIELDS)], more, g[M.TARGET].to_numpy(), w)
            seen += 2
    assert seen == len(got) > 4
    some = C.filter_coefficients(table, school_name="ho", group="GOOD", specification="Controlled", bandwidth_m=300, term="TREAT").collect()
    assert sorted(r.term for r in some) == ["treat", "treat:running_km"] and {r.boundary_school_name for r in some} == {"HOT"}


def test_interaction_coefficients(spark, monkeypatch):
    monkeypatch.setattr(L.chunk_sizes, "__defaults__", (150,))
    f = boundary(3)
    got = {}
    for r in C.interaction_coefficients(spark.createDataFrame(f), (100, 300)).collect():
        got.setdefault((r.bandwidth_m, r.specification), []).append(r)
    for h in (100, 300):
        g = f[f["signed_distance_m"].abs() <= h]
        t, km, tk = jump_columns(g)
        good = g["is_good_school"].to_numpy(float)
        base = np.column_stack([np.ones(len(g)), t, km, tk, t * good, km * good, tk * good, dense(g, [], ["boundary_school_name"])[:, 1:]])
        more = np.column_stack([base, dense(g, M.STRUCTURE, R.CONTROL_FIELDS)[:, 1:]])
        w = np.clip(1 - g["signed_distance_m"].abs() / h, 0, None).to_numpy()
        names = ["Intercept", "treat", "running_km", "treat:running_km", "treat:good_school", "running_km:good_school", "treat:running_km:good_school",
                 *dummy_names(g, ["boundary_school_name"])]
        check_table(got[float(h), "uncontrolled"], names, base, g[M.TARGET].to_numpy(), w)
        check_table(got[float(h), "controlled"], [*names, *M.STRUCTURE, *dummy_names(g, R.CONTROL_FIELDS)], more, g[M.TARGET].to_numpy(), w)


def test_tails():
    assert normal_two_sided(1.959963985) == pytest.approx(0.05, rel=1e-8)
    assert student_two_sided(2.0, 10) == pytest.approx(0.07338803477, rel=1e-8)
    assert student_two_sided(1.0, 1) == pytest.approx(0.5)
    assert student_quantile_975(10) == pytest.approx(2.228138852, rel=1e-8)


def test_penalised_fits_prove_themselves():
    """Nearly equal columns and a constant one: every fit meets the optimality conditions of its penalty."""
    from estatelens.operators.gram import Sums

    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    x[:, 4] = x[:, 3] + 0.05 * rng.normal(size=400)
    x[:, 5] = 0.0
    y = x @ np.array([2.0, 0, -1, 1, 1, 0, 0, 0.01]) + rng.normal(size=400)
    x, y = x - x.mean(axis=0), y - y.mean()
    sums = [Sums(len(rows), x[rows].T @ x[rows], x[rows].T @ y[rows], float(y[rows] @ y[rows])) for rows in (range(400), range(150))]
    penalties = [(a, r) for a in (1e-3, 0.1, 10.0) for r in (0.1, 1.0)]
    beta = M.elastic_nets(sums, penalties, tol=1e-13)
    for f, s in enumerate(sums):
        for m, (a, r) in enumerate(penalties):
            b = beta[f, :, m]
            slope = s.xy - s.xx @ b - s.n * a * (1 - r) * b
            limit = s.n * a * r
            assert (np.abs(slope) <= limit + 1e-3).all() and np.allclose(slope[b != 0], np.sign(b[b != 0]) * limit, atol=1e-3)
    gaps = M.duality_gaps(sums, penalties, beta)
    assert (gaps <= 1e-13 * np.array([[s.yy] for s in sums])).all() and (M.duality_gaps(sums, penalties, beta * 1.1 + 0.1) > 1e-3).all()
    with pytest.raises(ValueError):
        M.elastic_nets(sums, [(0.1, 0.0)])


def test_folds_shuffle_no_rows(spark):
    """Only keys are sorted for the folds, and the sums of a fold need no shuffle of its rows; ties fall back to numbers."""
    df = spark.range(1003).selectExpr("(id * 7919) % 1003 as k", "cast(id as double) as x").repartition(4)
    folded = M.fold_of(df, ["k"], 5)
    assert "Exchange rangepartitioning" not in folded._jdf.queryExecution().toString() and "row_index" not in folded.columns
    assert [r.n for r in folded.groupBy("fold").agg(F.count("*").alias("n"), F.min("k").alias("k")).orderBy("fold").collect()] == [201, 201, 201, 200, 200]
    tied = M.fold_of(df.withColumn("k", F.lit(1)), ["k"], 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in tied) == [200, 200, 201, 201, 201]
    few = M.fold_of(spark.range(3).withColumn("k", -F.col("id")), ["k"], 5)
    assert sorted(r.fold for r in few.collect()) == [0, 1, 2]
    nulls = M.fold_of(df.withColumn("k", F.when(F.col("k") > 100, F.col("k"))), ["k"], 5)
    assert nulls.where("k is null").agg(F.max("fold")).first()[0] == 0


def test_sums_of_few_groups_equal_sums_by_chunks(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k % 3), None if k % 7 == 0 else float(v), "ab"[k % 2] if k % 5 else None, float(v * 2 + k % 2)) for k, v in enumerate(rng.standard_normal(600))]
    df = spark.createDataFrame(rows, "g int, x double, c string, y double").repartition(5)
    design = L.Design(("x",), {"c": ("a", "b")}, fills={"x": 0.25, "c": "b"})
    few, chunks = (
        {(r.g, r.i, r.j): r.s for r in cells.collect()}
        for cells in (L.few_grams(df, design, "y", "g"), L.gram(df, design, "y", by=["g"]))
    )
    assert few.keys() == chunks.keys() and all(abs(few[k] - chunks[k]) < 1e-9 for k in few)
