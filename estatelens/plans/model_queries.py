"""Price models and boundary discontinuity studies over the sample sales."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import coefficients as C, models as M, rdd as R, spatial as G
from ..operators.gram import collect_sums, gram
from ..scratch import materialize
from .aggregate_queries import rounded
from .equations import cross_products, dummy, term
from .filter_queries import RESULTS, result_rows
from .registry import query, r6
from .spatial_queries import _AREA, edges, points
from .scalar_queries import priced

KEY = ["txn_id"]


def features(t):
    """The model table, written once: the fits below pass over it several times."""
    return materialize(M.engineer_features(t.f_feature, keep=KEY))


def split(t):
    return M.time_split(features(t), 12)


# Model rows in SQL, with the split, for the checks below.
_F = r"""(SELECT *, m >= (SELECT max(CAST(month || '-01' AS DATE)) FROM {f_txn} mx WHERE resale_price IS NOT NULL) - INTERVAL 11 MONTH AS is_test FROM (SELECT txn_id, town,
 flat_type, flat_model, resale_price, ln(resale_price) AS y, floor_area_sqm, CAST(month || '-01' AS DATE) AS m,
 CAST(CAST(substr(month,1,4) AS INTEGER) - lease_commence_date AS DOUBLE) AS lease_age_years,
 (CAST(substr(storey_range,1,2) AS DOUBLE) + CAST(substr(storey_range,7,2) AS DOUBLE)) / 2 AS storey_mid,
 ln(greatest(nearest_pcn_walking_distance_m, 1)) * CASE WHEN nearest_pcn_walking_distance_m IS NULL THEN NULL ELSE 1 END AS ln_pcn,
 ln(greatest(nearest_mall_walking_distance_m, 1)) AS ln_mall, good_school_count_1km, school_count_2km, parks_within_5min_walk
 FROM {f_feature} f WHERE resale_price IS NOT NULL) g)"""

_EDGES = """(SELECT list_sort(list_distinct(quantile_cont(floor_area_sqm, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS e FROM """ + _F + """ q WHERE NOT is_test)"""
_BINNED = "(SELECT t.*, greatest(0, len(list_filter(e, lambda v: v < floor_area_sqm)) - 1) AS bin FROM " + _F + " t CROSS JOIN " + _EDGES + " ed WHERE NOT is_test)"
_SIZES = "(SELECT bin, count(*) AS n FROM " + _BINNED + " b GROUP BY bin)"


@query("quantile_bins", f"SELECT txn_id, CAST(bin AS INTEGER) AS floor_area_bin FROM {_BINNED} t")
def quantile_bins(t):
    train, _ = split(t)
    cuts = M.quantile_edges(train, "floor_area_sqm", 8)
    return train.select("txn_id", M.bin_of(F.col("floor_area_sqm"), cuts).alias("floor_area_bin"))


@query("rebalance_by_floor_area", f"""WITH s AS {_SIZES}, g AS (SELECT CAST(floor(quantile_cont(n, 0.75)) AS BIGINT) AS target FROM s)
 SELECT CAST(bin AS INTEGER) AS floor_area_bin, greatest(n, target) AS rows FROM s, g""")
def rebalance_by_floor_area(t):
    """Rows per bin after rebalancing; the rows drawn depend on Spark's hash."""
    train, _ = split(t)
    out = M.rebalance(train, "floor_area_sqm", 8, 0.75, KEY, seed=42)
    return out.groupBy("floor_area_bin").agg(F.count("*").alias("rows"))


@query("floor_area_weights", f"""WITH s AS {_SIZES}, g AS (SELECT quantile_cont(n, 0.75) AS target FROM s)
 SELECT txn_id, round(greatest(1.0, target / s.n), 6) AS sample_weight FROM {_BINNED} b JOIN s ON b.bin = s.bin, g""")
def floor_area_weights(t):
    train, _ = split(t)
    return M.balance_weights(train, "floor_area_sqm", 8, 0.75).select("txn_id", r6("sample_weight", "sample_weight"))


@query("impute_median", f"""SELECT txn_id, round(coalesce(ln_pcn, (SELECT quantile_cont(ln_pcn, 0.5) FROM {_F} q WHERE NOT is_test)), 6) AS ln_pcn FROM {_F} t""")
def impute_median(t):
    train, test = split(t)
    prep = M.prepare(train, ["ln_nearest_pcn_walking_distance_m"], [])
    return prep.filled(train.unionByName(test)).select("txn_id", r6("ln_nearest_pcn_walking_distance_m", "ln_pcn"))


@query("standardize", f"""SELECT txn_id, round((floor_area_sqm - m1) / s1, 6) AS z_area, round((ln_mall - m2) / s2, 6) AS z_mall FROM {_F} t CROSS JOIN
 (SELECT avg(floor_area_sqm) AS m1, stddev_pop(floor_area_sqm) AS s1, avg(ln_mall) AS m2, stddev_pop(ln_mall) AS s2 FROM {_F} q WHERE NOT is_test) p""")
def standardize(t):
    train, test = split(t)
    cols = ["floor_area_sqm", "ln_nearest_mall_walking_distance_m"]
    prep = M.prepare(train, cols, [])
    return train.unionByName(test).select(
        "txn_id", r6(prep.scaled(cols[0]), "z_area"), r6(prep.scaled(cols[1]), "z_mall")
    )


@query("impute_mode_one_hot", f"""SELECT txn_id, CAST(f = '1-URGENT' AS INTEGER) AS l0, CAST(f = '2-HIGH' AS INTEGER) AS l1, CAST(f = '3-MEDIUM' AS INTEGER) AS l2,
 CAST(f = '4-NOT SPECIFIED' AS INTEGER) AS l3, CAST(f = '5-LOW' AS INTEGER) AS l4 FROM (SELECT txn_id, CASE WHEN txn_id % 10 = 0 THEN NULL WHEN txn_id % 10 = 1 THEN 'UNSEEN' ELSE flat_type END AS raw,
 coalesce(raw, (SELECT flat_type FROM {_F} q WHERE NOT is_test GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS f FROM {_F} x) t""")
def impute_mode_one_hot(t):
    train, test = split(t)
    prep = M.prepare(train, ["floor_area_sqm"], ["flat_type"])
    k = F.col("txn_id") % 10
    both = train.unionByName(test).withColumn(
        "flat_type", F.when(k == 1, "UNSEEN").when(k > 1, F.col("flat_type"))
    )
    hot = M.one_hot(both, prep)
    return hot.select("txn_id", *[F.col(f"`flat_type={v}`").alias(f"l{i}") for i, v in enumerate(prep.levels["flat_type"])])


# Ridge on two columns, solved by hand.
_RIDGE = f"""p AS (SELECT avg(floor_area_sqm) AS ma, stddev_pop(floor_area_sqm) AS sa, avg(storey_mid) AS mb, stddev_pop(storey_mid) AS sb, avg(y) AS my FROM {_F} q WHERE NOT is_test),
 z AS (SELECT txn_id, is_test, y, resale_price, (floor_area_sqm - ma) / sa AS a, (storey_mid - mb) / sb AS b, my FROM {_F} t, p),
 g AS (SELECT sum(a * a) + 1 AS aa, sum(b * b) + 1 AS bb, sum(a * b) AS ab, sum(a * (y - my)) AS ay, sum(b * (y - my)) AS by_ FROM z WHERE NOT is_test),
 c AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS bb FROM g),
 f AS (SELECT z.*, my + c.ba * a + c.bb * b AS yhat FROM z, c)"""
_PAIR = ["floor_area_sqm", "storey_mid"]


def small_ridge(t):
    train, test = split(t)
    return train, test, M.fit_ridge(train, _PAIR, fields=[])


@query("ridge_fit", f"""WITH {_RIDGE} SELECT 'num__floor_area_sqm' AS feature, round(ba, 8) AS coefficient FROM c UNION ALL SELECT 'num__storey_mid', round(bb, 8) FROM c""")
def ridge_fit(t):
    model = small_ridge(t)[2]
    return model.importance(t.spark).select("feature", r6("coefficient", "coefficient", 8))


@query("batch_predict", f"""WITH {_RIDGE} SELECT txn_id, round(yhat, 6) AS predicted_log_price, round(exp(yhat), 4) AS predicted_resale_price,
 CASE WHEN is_test THEN 'test' ELSE 'train' END AS dataset_split FROM f""")
def batch_predict(t):
    train, test, model = small_ridge(t)
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return model.predict(both).select(
        "txn_id", r6("predicted_log_price", "predicted_log_price"), r6("predicted_resale_price", "predicted_resale_price", 4),
        S.split_label(F.col("is_test")).alias("dataset_split"),
    )


@query("regression_metrics", f"""WITH {_RIDGE} SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS dataset_split, count(*) AS rows,
 round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2_log, round(sqrt(avg(pow(resale_price - exp(yhat), 2))), 4) AS rmse,
 round(avg(abs(resale_price - exp(yhat))), 4) AS mae FROM f GROUP BY is_test""")
def regression_metrics(t):
    train, test, model = small_ridge(t)
    parts = [
        M.prediction_metrics(df, {"m": model}).select(
            F.lit(name).alias("dataset_split"), "rows", r6("r2_log", "r2_log"), r6("rmse", "rmse", 4), r6("mae", "mae", 4)
        )
        for name, df in (("train", train), ("test", test))
    ]
    return parts[0].unionByName(parts[1])


@query("feature_importance")
def feature_importance(t):
    """Coefficients of the full ridge by size."""
    train, _ = split(t)
    out = M.fit_ridge(train, list(M.REDUCED_NUMERIC)).importance(t.spark)
    return out.select("feature", r6("coefficient", "coefficient"), r6("abs_coefficient", "abs_coefficient"))


_TRAIN = f"(SELECT *, strftime(m, '%Y-%m') AS month_period FROM {_F} q WHERE NOT is_test)"
_FEATURES = " UNION ALL ".join([f"SELECT 'num__{c}' AS feature" for c in M.REDUCED_NUMERIC] + [
    f"SELECT DISTINCT 'cat__{c}_' || {c} FROM {_TRAIN} t{i} WHERE {c} IS NOT NULL" for i, c in enumerate(M.CATEGORIES)
])


@query("ridge_equations", f"SELECT feature, 0.0 AS gap FROM ({_FEATURES}) f")
def ridge_equations(t):
    """Every equation of the full ridge: cross product with the residuals less alpha times the coefficient; all are 0."""
    train, _ = split(t)
    out = M.fit_ridge(train, list(M.REDUCED_NUMERIC), alpha=1.0).slopes(train)
    return out.select("feature", r6(F.abs(F.col("slope") - F.col("coefficient")), "gap", 5))


@query("ridge_weighted")
def ridge_weighted(t):
    """Ridge with floor-area weights: train and test metrics."""
    train, test = split(t)
    weighted = M.balance_weights(train, "floor_area_sqm", 8, 0.75)
    model = M.fit_ridge(weighted, list(M.REDUCED_NUMERIC), weight="sample_weight")
    return M.prediction_metrics(train, {"train": model}).unionByName(M.prediction_metrics(test, {"test": model}))


_OLS = f"""r AS (SELECT floor_area_sqm AS a, lease_age_years AS b, y FROM {_F} q WHERE NOT is_test),
 m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) AS n FROM r),
 s AS (SELECT sum((a - ma) * (a - ma)) AS aa, sum((b - mb) * (b - mb)) AS bb, sum((a - ma) * (b - mb)) AS ab, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS by_,
  sum((y - my) * (y - my)) AS yy FROM r, m),
 c AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb, s.*, aa * bb - ab * ab AS det FROM s),
 v AS (SELECT c.*, m.*, (yy - ca * ay - cb * by_) / (n - 3) AS s2 FROM c, m)"""


@query("ols_fit", f"""WITH {_OLS} SELECT 'floor_area_sqm' AS term, round(ca, 8) AS coef, round(sqrt(s2 * bb / det), 8) AS std_err, round(ca / sqrt(s2 * bb / det), 6) AS t FROM v
 UNION ALL SELECT 'lease_age_years', round(cb, 8), round(sqrt(s2 * aa / det), 8), round(cb / sqrt(s2 * aa / det), 6) FROM v
 UNION ALL SELECT 'Intercept', round(my - ca * ma - cb * mb, 8), round(sqrt(s2 * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)), 8),
 round((my - ca * ma - cb * mb) / sqrt(s2 * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)), 6) FROM v""")
def ols_fit(t):
    train, _ = split(t)
    out = M.ols_table(train, ["floor_area_sqm", "lease_age_years"], [])
    return out.select("term", r6("coef", "coef", 8), r6("std_err", "std_err", 8), r6("t", "t"))


@query("ols_full")
def ols_full(t):
    """The pooled least-squares table with town, type, model and month effects."""
    train, _ = split(t)
    numeric = [c for c in M.FULL_NUMERIC if c not in ("sale_year", "sale_month", "months_since_start")]
    return M.ols_table(train, numeric, ["town", "flat_type", "flat_model", "month_period"])


_OLS_NUMERIC = [c for c in M.FULL_NUMERIC if c not in ("sale_year", "sale_month", "months_since_start")]
_OLS_FIELDS = ["town", "flat_type", "flat_model", "month_period"]
_COMPLETE = f"(SELECT * FROM {_TRAIN} u WHERE ln_pcn IS NOT NULL AND ln_mall IS NOT NULL AND lease_age_years IS NOT NULL AND storey_mid IS NOT NULL)"


@query("ols_equations", "SELECT 'Intercept' AS term, 0.0 AS gap" + "".join(f" UNION ALL SELECT '{c}', 0.0" for c in _OLS_NUMERIC) + "".join(
    f" UNION ALL SELECT 'C({c})[T.' || v || ']', 0.0 FROM (SELECT DISTINCT {c} AS v, min({c}) OVER () AS first FROM {_COMPLETE} c{i}) d{i} WHERE v <> first"
    for i, c in enumerate(_OLS_FIELDS)
))
def ols_equations(t):
    """Mean cross products of residuals and terms of `ols_full`; all are 0."""
    train, _ = split(t)
    rows = train.dropna(subset=[*_OLS_NUMERIC, *_OLS_FIELDS])
    terms = [term("Intercept", F.lit(1.0)), *(term(c, F.col(c)) for c in _OLS_NUMERIC), *(dummy(c) for c in _OLS_FIELDS)]
    entries = rows.select(F.col(M.TARGET).alias("y"), F.lit(1.0).alias("w"), F.array(*terms).alias("x"))
    out = cross_products(entries, [], M.ols_table(train, _OLS_NUMERIC, _OLS_FIELDS))
    return out.select("term", r6(F.abs("cross") / rows.select(F.count("*")).scalar(), "gap", 5))


@query("nested_spec_trace")
def nested_spec_trace(t):
    return M.nested_trace(features(t))


MIN_ROWS = 500


@query("town_premium_fit")
def town_premium_fit(t):
    return M.town_premiums(features(t), min_rows=MIN_ROWS)[0]


@query("town_premium_skipped", f"""SELECT town, count(*) AS rows, round(avg(CASE WHEN good_school_count_1km > 0 THEN 1 ELSE 0 END), 6) AS treated_share,
 'below_threshold' AS reason FROM {_F} t GROUP BY town HAVING count(*) < {MIN_ROWS} OR avg(CASE WHEN good_school_count_1km > 0 THEN 1.0 ELSE 0 END) < 0.05""")
def town_premium_skipped(t):
    return rounded(M.town_premiums(features(t), min_rows=MIN_ROWS)[1], {"treated_share"}, 6)


def _train_sums(t, numeric):
    train, _ = split(t)
    prep = M.prepare(train, list(numeric), [])
    design = prep.design(float(train.agg(F.avg(M.TARGET)).first()[0]))
    return collect_sums(gram(train, design, M.TARGET)), prep


@query("vif_prune")
def vif_prune(t):
    """Columns left after dropping those of large variance inflation."""
    sums, prep = _train_sums(t, M.FULL_NUMERIC)
    left = M.vif_prune(sums, prep, list(M.FULL_NUMERIC), 10.0)
    return t.spark.createDataFrame([(i, c) for i, c in enumerate(left)], "position int, feature string")


_KB = {"floor_area_sqm": "floor_area_sqm", "lease_age_years": "lease_age_years", "storey_mid": "storey_mid",
       "ln_nearest_mall_walking_distance_m": "ln_mall", "good_school_count_1km": "good_school_count_1km",
       "school_count_2km": "school_count_2km", "parks_within_5min_walk": "parks_within_5min_walk"}


@query("select_k_best", "SELECT feature, round(r * r / (1 - r * r) * (n - 2), 6) AS f_score FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS feature, corr({v}, y) AS r, count(*) AS n FROM {_F} f{i} WHERE NOT is_test" for i, (k, v) in enumerate(_KB.items())
) + ") t ORDER BY f_score DESC LIMIT 4")
def select_k_best(t):
    sums, prep = _train_sums(t, _KB)
    chosen = M.select_k_best(sums, prep, list(_KB), 4)
    scores = M.f_scores(sums, prep, list(_KB))
    rows = t.spark.createDataFrame([(c, float(scores[c])) for c in chosen], "feature string, f double")
    return rows.select("feature", r6("f", "f_score"))


def _penalised(t, ratios):
    train, test = split(t)
    model, alpha, ratio = M.fit_penalised(train, list(M.REDUCED_NUMERIC), KEY, ratios)
    out = M.prediction_metrics(test, {"test": model})
    return out.withColumns({"alpha": F.lit(alpha), "l1_ratio": F.lit(ratio)})


@query("lasso_cv")
def lasso_cv(t):
    return _penalised(t, [1.0])


@query("elastic_net_cv")
def elastic_net_cv(t):
    return _penalised(t, list(M.RATIOS))


def _conditions(t, ratios):
    """Per term, whether the chosen fit meets its condition: a slope at the penalty, or below it where the coefficient is 0."""
    train, _ = split(t)
    model, alpha, ratio = M.fit_penalised(train, list(M.REDUCED_NUMERIC), KEY, ratios)
    slope = F.col("slope") / train.select(F.count("*")).scalar() - alpha * (1 - ratio) * F.col("coefficient")
    off = F.when(F.col("coefficient") == 0, F.abs(slope) - alpha * ratio).otherwise(F.abs(slope - F.signum("coefficient") * alpha * ratio))
    return model.slopes(train).select("feature", (off <= 0.002).alias("holds"))


@query("lasso_conditions", f"SELECT feature, TRUE AS holds FROM ({_FEATURES}) f")
def lasso_conditions(t):
    return _conditions(t, [1.0])


@query("elastic_net_conditions", f"SELECT feature, TRUE AS holds FROM ({_FEATURES}) f")
def elastic_net_conditions(t):
    return _conditions(t, list(M.RATIOS))


@query("variant_benchmark")
def variant_benchmark(t):
    train, test = split(t)
    return M.variant_benchmark(train, test, KEY)


@query("score_with_defaults")
def score_with_defaults(t):
    """Price partial requests: every sale with some of its inputs withheld."""
    sales = t.f_feature
    train, _ = split(t)
    model = M.fit_ridge(train, list(M.REDUCED_NUMERIC))
    start = sales.agg(F.min("month")).first()[0]
    k = F.col("txn_id") % 3
    requests = sales.select(
        "txn_id", "town", F.when(k != 0, F.col("flat_type")).alias("flat_type"),
        F.when(k == 1, F.col("floor_area_sqm")).alias("floor_area_sqm"),
    )
    out = M.score_with_defaults(requests, M.prediction_defaults(sales), model, start)
    return out.select(
        "txn_id", "predicted_price", "used_defaults",
        F.array_join("provided_raw_fields", ",").alias("provided"), F.size("defaulted_raw_fields").alias("n_defaulted"),
    )


# -- boundary discontinuity -------------------------------------------------------------------

LEAST_ROWS, LEAST_SIDE = 100, 30


def boundary(t):
    """Sales near the edge of each 1 km area."""
    near = G.signed_band(points(t), edges(t.f_area_edge), 500)
    named = near.join(points(t).select("point_id", "address_key"), "point_id").join(
        t.f_school.select(F.col("school_id").alias("poly_id"), F.col("school_name").alias("boundary_school_name"), "is_good_school"), "poly_id"
    )
    distances = named.select("address_key", "boundary_school_name", "is_good_school", "signed_distance_m", F.col("inside").alias("inside_good_school_1km"))
    return R.boundary_sales(R.rdd_features(t.f_txn), distances)


_LOCAL = f"""b AS (SELECT a.address_key, q.school_name, q.good, CASE WHEN odd OR on_edge THEN -d ELSE d END AS d FROM {_AREA} q JOIN {{f_address}} a ON a.ck = q.ck WHERE q.d <= 500),
 r AS (SELECT b.school_name, b.good, ln(x.resale_price) AS y, x.resale_price, b.d, b.d / 1000 AS km, h.h, greatest(0, 1 - abs(b.d) / h.h) AS w, b.d <= 0 AS inside
  FROM {{f_txn}} x JOIN b ON x.address_key = b.address_key CROSS JOIN (SELECT unnest([100.0, 200.0, 300.0, 500.0])::DOUBLE AS h) h
  WHERE x.resale_price IS NOT NULL AND x.remaining_lease IS NOT NULL AND abs(b.d) <= h.h),
 k AS (SELECT s.school_name, s.good, h.h, coalesce(n, 0) AS n, coalesce(n_in, 0) AS n_in, coalesce(n, 0) - coalesce(n_in, 0) AS n_out FROM (SELECT DISTINCT school_name, good FROM r) s
  CROSS JOIN (SELECT unnest([100.0, 200.0, 300.0, 500.0])::DOUBLE AS h) h LEFT JOIN (SELECT school_name, h, count(*) AS n, count(*) FILTER (WHERE inside) AS n_in FROM r GROUP BY 1, 2) c
  ON c.school_name = s.school_name AND c.h = h.h)"""
_FIT = f"n >= {LEAST_ROWS} AND n_in >= {LEAST_SIDE} AND n_out >= {LEAST_SIDE}"
# The uncontrolled fit is one weighted line on each side of the boundary.
_LINES = _LOCAL + f""", s AS (SELECT school_name, h, inside, sum(w) AS s0, sum(w * km) AS s1, sum(w * km * km) AS s2, sum(w * y) AS t0, sum(w * km * y) AS t1 FROM r GROUP BY 1, 2, 3),
 l AS (SELECT *, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS slope, (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) AS level, s0 * s2 - s1 * s1 AS det FROM s),
 e AS (SELECT r.*, l.level + l.slope * r.km AS fit, (l.s2 - l.s1 * r.km) / l.det AS lev FROM r JOIN l ON l.school_name = r.school_name AND l.h = r.h AND l.inside = r.inside),
 u AS (SELECT school_name, h, sum(pow(w * (y - fit) * lev, 2)) AS meat, 1 - sum(w * pow(y - fit, 2)) / (sum(w * y * y) - pow(sum(w * y), 2) / sum(w)) AS r2,
  avg(resale_price) AS mean_price, quantile_cont(resale_price, 0.5) AS median_price FROM e GROUP BY 1, 2),
 o AS (SELECT k.*, i.level - j.level AS coef, sqrt(u.meat * k.n / (k.n - 4)) AS se, u.* EXCLUDE (school_name, h) FROM k JOIN u ON u.school_name = k.school_name AND u.h = k.h
  JOIN l i ON i.school_name = k.school_name AND i.h = k.h AND i.inside JOIN l j ON j.school_name = k.school_name AND j.h = k.h AND NOT j.inside WHERE {_FIT})"""


def sweep(t):
    return R.rdd_sweep(boundary(t), min_total=LEAST_ROWS, min_side=LEAST_SIDE)


def uncontrolled(t):
    return sweep(t)[0].where("specification = 'uncontrolled'")


@query("local_linear_rdd", f"""WITH {_LINES} SELECT school_name AS boundary_school_name, h AS bandwidth_m, n AS sample_size, n_in AS inside_n, n_out AS outside_n,
 round(coef, 6) AS cutoff_coef_log_points, round(r2, 6) AS r_squared FROM o""")
def local_linear_rdd(t):
    return uncontrolled(t).select(
        "boundary_school_name", "bandwidth_m", "sample_size", "inside_n", "outside_n",
        r6("cutoff_coef_log_points", "cutoff_coef_log_points"), r6("r_squared", "r_squared"),
    )


@query("hc1_cov", f"""WITH {_LINES} SELECT school_name AS boundary_school_name, h AS bandwidth_m, round(se, 6) AS cutoff_std_err FROM o""")
def hc1_cov(t):
    return uncontrolled(t).select("boundary_school_name", "bandwidth_m", r6("cutoff_std_err", "cutoff_std_err"))


@query("rdd_metrics", f"""WITH {_LINES} SELECT school_name AS boundary_school_name, CASE WHEN good THEN 'good' ELSE 'non_good' END AS school_group, h AS bandwidth_m,
 round(exp(coef) - 1, 6) AS cutoff_premium_pct, round(exp(coef - 1.96 * se) - 1, 5) AS cutoff_ci_low_pct, round(exp(coef + 1.96 * se) - 1, 5) AS cutoff_ci_high_pct,
 round((exp(coef) - 1) * mean_price, 2) AS jump_at_mean, round((exp(coef) - 1) * median_price, 2) AS jump_at_median, round(mean_price, 4) AS local_mean_resale_price,
 round(median_price, 4) AS local_median_resale_price FROM o""")
def rdd_metrics(t):
    return uncontrolled(t).select(
        "boundary_school_name", "school_group", "bandwidth_m", r6("cutoff_premium_pct", "cutoff_premium_pct"),
        r6("cutoff_ci_low_pct", "cutoff_ci_low_pct", 5), r6("cutoff_ci_high_pct", "cutoff_ci_high_pct", 5),
        r6("cutoff_price_jump_sgd_at_local_mean_price", "jump_at_mean", 2),
        r6("cutoff_price_jump_sgd_at_local_median_price", "jump_at_median", 2),
        r6("local_mean_resale_price", "local_mean_resale_price", 4), r6("local_median_resale_price", "local_median_resale_price", 4),
    )


@query("rdd_sweep")
def rdd_sweep(t):
    """All fits, with and without controls."""
    return sweep(t)[0]


@query("rdd_skipped", f"""WITH {_LOCAL} SELECT school_name AS boundary_school_name, CASE WHEN good THEN 'good' ELSE 'non_good' END AS school_group, h AS bandwidth_m,
 n AS sample_size, n_in AS inside_n, n_out AS outside_n, 'insufficient_boundary_sample' AS reason FROM k WHERE NOT ({_FIT})""")
def rdd_skipped(t):
    return sweep(t)[1]


@query("rdd_interaction")
def rdd_interaction(t):
    """Pooled fits with school effects."""
    return R.rdd_interaction(boundary(t))


@query("rdd_summary", f"""WITH {_LOCAL} SELECT (SELECT count(DISTINCT address_key) FROM {{f_txn}} q WHERE resale_price IS NOT NULL) AS transactions_with_geocoded_addresses,
 (SELECT count(*) FROM {{f_txn}} q WHERE resale_price IS NOT NULL) AS transaction_rows_used, (SELECT count(*) FROM {{f_school}} s) AS school_buffers_total,
 (SELECT count(*) FROM {{f_school}} s WHERE is_good_school) AS school_buffers_good, (SELECT count(*) FROM {{f_school}} s WHERE NOT is_good_school) AS school_buffers_non_good,
 (SELECT count(*) FROM r WHERE h = 500) AS school_specific_rows_used, (SELECT count(DISTINCT school_name) FROM k WHERE {_FIT}) AS school_specific_schools_with_results""")
def rdd_summary(t):
    near = boundary(t)
    results = R.rdd_sweep(near, min_total=LEAST_ROWS, min_side=LEAST_SIDE)[0]
    return R.rdd_summary(R.rdd_features(t.f_txn), t.f_school, near, results)


@query("premium_attribution", f"""WITH p AS (SELECT boundary_school_name AS k, cutoff_premium_pct AS v FROM {RESULTS} r WHERE specification = 'controlled' AND bandwidth_m = 300),
 f AS (SELECT t.txn_id, t.floor_area_sqm * 5000 AS p, CASE WHEN t.txn_id % 5 = 0 THEN '' ELSE t.town || ', ' || s.school_name END AS names FROM {{f_txn}} t JOIN {{f_school}} s ON s.school_id = t.txn_id % 25),
 e AS (SELECT txn_id, upper(trim(unnest(string_split(names, ',')))) AS n FROM f), m AS (SELECT txn_id, avg(v) AS v FROM e JOIN p ON e.n = p.k GROUP BY 1)
 SELECT f.txn_id, round(m.v, 6) AS school_rdd_premium_pct, round(f.p * m.v, 4) AS premium_price, m.v IS NOT NULL AS has_flat_premium FROM f LEFT JOIN m ON f.txn_id = m.txn_id""")
def premium_attribution(t):
    s = t.f_school.select("school_id", "school_name")
    flats = priced(t).withColumn("school_id", (F.col("txn_id") % 25).cast("int")).join(s, "school_id").select(
        "txn_id", "predicted_resale_price",
        F.when(F.col("txn_id") % 5 == 0, "").otherwise(F.concat_ws(", ", "town", "school_name")).alias("names"),
    )
    out = R.premium_attribution(flats, "txn_id", "names", result_rows(t), bandwidth=300)
    return out.select(
        "txn_id", r6("school_rdd_premium_pct", "school_rdd_premium_pct"), r6("premium_price", "premium_price", 4), "has_flat_premium"
    )


# All four terms of the uncontrolled fit: level and slope outside, and what inside differs from them.
_TERMS = _LINES + """, g AS (SELECT school_name, h, inside, sum(pow(w * (y - fit), 2) * pow((s2 - s1 * km) / det, 2)) AS v0, sum(pow(w * (y - fit), 2) * pow((s0 * km - s1) / det, 2)) AS v1
  FROM (SELECT e.*, l.s0, l.s1, l.s2, l.det FROM e JOIN l ON l.school_name = e.school_name AND l.h = e.h AND l.inside = e.inside) q GROUP BY 1, 2, 3),
 f AS (SELECT k.school_name, k.good, k.h, CAST(k.n AS DOUBLE) / (k.n - 4) AS c, i.level AS li, j.level AS lj, i.slope AS si, j.slope AS sj, a.v0 AS a0, a.v1 AS a1, b.v0 AS b0, b.v1 AS b1
  FROM k JOIN l i ON i.school_name = k.school_name AND i.h = k.h AND i.inside JOIN l j ON j.school_name = k.school_name AND j.h = k.h AND NOT j.inside
  JOIN g a ON a.school_name = k.school_name AND a.h = k.h AND a.inside JOIN g b ON b.school_name = k.school_name AND b.h = k.h AND NOT b.inside WHERE """ + _FIT + """),
 t AS (SELECT school_name, good, h, 'Intercept' AS term, lj AS coef, sqrt(c * b0) AS se FROM f UNION ALL SELECT school_name, good, h, 'treat', li - lj, sqrt(c * (a0 + b0)) FROM f
  UNION ALL SELECT school_name, good, h, 'running_km', sj, sqrt(c * b1) FROM f UNION ALL SELECT school_name, good, h, 'treat:running_km', si - sj, sqrt(c * (a1 + b1)) FROM f)"""


@query("rdd_coefficients", f"""WITH {_TERMS} SELECT school_name AS boundary_school_name, CASE WHEN good THEN 'good' ELSE 'non_good' END AS school_group, h AS bandwidth_m, term,
 round(coef, 6) AS coef, round(se, 6) AS std_err, round(coef / se, 4) AS z, round(coef - 1.959963984540054 * se, 6) AS ci_low, round(coef + 1.959963984540054 * se, 6) AS ci_high FROM t""")
def rdd_coefficients(t):
    """Every term of the fits without controls, with robust errors."""
    table = C.filter_coefficients(school_terms(t), specification="uncontrolled")
    return table.select(
        "boundary_school_name", "school_group", "bandwidth_m", "term", r6("coef", "coef"), r6("std_err", "std_err"), r6("z", "z", 4),
        r6("ci_low", "ci_low"), r6("ci_high", "ci_high"),
    )


def school_terms(t):
    return C.sweep_coefficients(boundary(t), min_total=LEAST_ROWS, min_side=LEAST_SIDE)


@query("rdd_term_search", f"""WITH {_TERMS} SELECT school_name AS boundary_school_name, h AS bandwidth_m, term, round(coef, 6) AS coef, round(se, 6) AS std_err FROM t
 WHERE good AND h = 300 AND contains(term, 'treat') AND contains(lower(school_name), 'nation_1')""")
def rdd_term_search(t):
    """Jump terms of some good schools at one bandwidth."""
    found = C.filter_coefficients(school_terms(t), school_name="Nation_1", group="GOOD", specification="Uncontrolled", bandwidth_m=300, term="TREAT")
    return found.select("boundary_school_name", "bandwidth_m", "term", r6("coef", "coef"), r6("std_err", "std_err"))


_STRUCTURE_ROWS = " UNION ALL ".join(f"SELECT '{c}'" for c in M.STRUCTURE)


def _levels(groups):
    """Dummies of the rows with weight, without the first level of each fit."""
    fields = {"town": "town", "flat_type": "flat_type", "flat_model": "flat_model", "month_period": "month"}
    return " UNION ALL ".join(f"""SELECT {groups}, 'C({name})[T.' || v || ']' AS term FROM (SELECT DISTINCT {groups}, {c} AS v, min({c}) OVER (PARTITION BY {groups}) AS first FROM w) q{i} WHERE v <> first"""
                              for i, (name, c) in enumerate(fields.items()))


_WIDE = """w AS (SELECT b.school_name, h.h, x.town, x.flat_type, x.flat_model, x.month FROM {f_txn} x JOIN b ON x.address_key = b.address_key
  CROSS JOIN (SELECT unnest([100.0, 200.0, 300.0, 500.0])::DOUBLE AS h) h WHERE x.resale_price IS NOT NULL AND x.remaining_lease IS NOT NULL AND abs(b.d) < h.h)"""
_JUMP_ROWS = "SELECT 'Intercept' AS term UNION ALL SELECT 'treat' UNION ALL SELECT 'running_km' UNION ALL SELECT 'treat:running_km'"


def jump_terms():
    return [term("Intercept", F.lit(1.0)), term("treat", F.col("treat")), term("running_km", F.col("running_km")), term("treat:running_km", F.col("treat_running"))]


def control_terms():
    return [*(term(c, F.col(c)) for c in M.STRUCTURE), *(dummy(c) for c in R.CONTROL_FIELDS)]


@query("rdd_sweep_equations", f"""WITH {_LOCAL}, {_WIDE}, p AS (SELECT school_name, h, term FROM (SELECT DISTINCT school_name, h FROM w) z CROSS JOIN ({_JUMP_ROWS} UNION ALL {_STRUCTURE_ROWS}) v
  UNION ALL {_levels("school_name, h")}) SELECT p.school_name AS boundary_school_name, p.h AS bandwidth_m, term, 0.0 AS cross_product FROM p JOIN k ON k.school_name = p.school_name AND k.h = p.h WHERE {_FIT}""")
def rdd_sweep_equations(t):
    """Weighted cross products of residuals and terms of every controlled fit; all are 0."""
    near, keys = boundary(t), ["boundary_school_name", "bandwidth_m"]
    table = C.filter_coefficients(C.sweep_coefficients(near, min_total=LEAST_ROWS, min_side=LEAST_SIDE), specification="controlled")
    rows = R.local_rows(near).select(*keys, F.col(M.TARGET).alias("y"), F.col("kernel_weight").alias("w"), F.array(*jump_terms(), *control_terms()).alias("x"))
    out = cross_products(rows, keys, table)
    return out.select(*keys, "term", r6(F.abs("cross"), "cross_product", 5))


@query("rdd_interaction_equations", f"""WITH {_LOCAL}, {_WIDE}, p AS (SELECT h, term FROM (SELECT DISTINCT h FROM w) z CROSS JOIN ({_JUMP_ROWS} UNION ALL SELECT 'treat:good_school'
  UNION ALL SELECT 'running_km:good_school' UNION ALL SELECT 'treat:running_km:good_school' UNION ALL {_STRUCTURE_ROWS}) v UNION ALL {_levels("h")}
  UNION ALL SELECT h, 'C(boundary_school_name)[T.' || v || ']' FROM (SELECT DISTINCT h, school_name AS v, min(school_name) OVER (PARTITION BY h) AS first FROM w) q WHERE v <> first)
 SELECT h AS bandwidth_m, term, 0.0 AS cross_product FROM p""")
def rdd_interaction_equations(t):
    """The same for the pooled fits with controls, school effects included."""
    near = boundary(t)
    table = C.filter_coefficients(C.interaction_coefficients(near), specification="controlled")
    good = [term("treat:good_school", F.col("treat_good")), term("running_km:good_school", F.col("running_good")), term("treat:running_km:good_school", F.col("treat_running_good"))]
    rows = R.local_rows(near).select("bandwidth_m", F.col(M.TARGET).alias("y"), F.col("kernel_weight").alias("w"),
                                     F.array(*jump_terms(), *good, *control_terms(), dummy("boundary_school_name")).alias("x"))
    out = cross_products(rows, ["bandwidth_m"], table)
    return out.select("bandwidth_m", "term", r6(F.abs("cross"), "cross_product", 5))


@query("rdd_interaction_coefficients")
def rdd_interaction_coefficients(t):
    """Every term of the pooled fits with robust errors."""
    return C.interaction_coefficients(boundary(t))
