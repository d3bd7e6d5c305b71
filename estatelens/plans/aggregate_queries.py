"""Grouped summaries over the whole sample sales."""

from pyspark.sql import functions as F

from ..operators import aggregates as A, filters as P
from ..operators.models import FALLBACK_NUMBER, prediction_defaults
from ..functions.scalar import parse_lines
from .filter_queries import RESULTS, result_rows
from .join_queries import _NEAR, near_schools
from .registry import query, r6
from .scalar_queries import priced

PRICE = "resale_price"
_FIVE = """count(resale_price) AS count, round(avg(resale_price), 6) AS mean, round(quantile_cont(resale_price, 0.5), 6) AS median,
 min(resale_price) AS min, max(resale_price) AS max"""


def rounded(df, columns, digits=6):
    """The frame with the given columns rounded and the others as they are."""
    return df.select(*[r6(c, c, digits) if c in columns else c for c in df.columns])


@query("resale_summary", f"SELECT {_FIVE} FROM {{f_txn}} t WHERE upper(flat_type) IN ('1-URGENT','5-LOW') AND month >= '1996-01' AND floor_area_sqm <= 120")
def resale_summary(t):
    sales = P.filter_sales(t.f_txn, flat_type=["1-URGENT", "5-low"], month_from="1996-01", max_floor_area_sqm=120)
    return rounded(A.sale_summary(sales), {"mean", "median"})


@query("resale_summary_by", f"SELECT town, {_FIVE} FROM {{f_txn}} t GROUP BY town")
def resale_summary_by(t):
    return rounded(A.sale_summary(t.f_txn, by="town"), {"mean", "median"})


_ROLL = """(SELECT address_key, town, block, street_name, count(*) AS txn_count, avg(resale_price) AS avg_resale_price,
 min(month) AS min_month, max(month) AS max_month FROM {f_txn} r GROUP BY 1, 2, 3, 4)"""


@query("address_rollup", f"SELECT address_key, town, block, street_name, txn_count, round(avg_resale_price, 6) AS avg_resale_price, min_month, max_month FROM {_ROLL} t")
def address_rollup(t):
    return rounded(A.address_rollup(t.f_txn), {"avg_resale_price"}, 6)


@query("polygon_rollup", f"""SELECT town AS poly_id, count(*) AS matched_point_count, CAST(sum(txn_count) AS BIGINT) AS matched_txn_count,
 round(avg(avg_resale_price), 6) AS mean_avg_resale_price FROM {_ROLL} t WHERE block <> '7' GROUP BY 1""")
def polygon_rollup(t):
    points = A.address_rollup(t.f_txn).withColumn("poly_id", F.when(F.col("block") != "7", F.col("town")))
    return rounded(A.polygon_rollup(points, "poly_id"), {"mean_avg_resale_price"})


@query("lines_per_station", """SELECT station, array_to_string(list_sort(list(DISTINCT line)), ';') AS lines, CAST(count(DISTINCT line) AS INTEGER) AS line_count
 FROM (SELECT 'STATION ' || CAST(amenity_id % 40 AS VARCHAR) AS station, unnest(CAST(lines_present_json AS JSON)::VARCHAR[]) AS line FROM {f_amenity} a) t GROUP BY station""")
def lines_per_station(t):
    rows = t.f_amenity.select(
        F.concat(F.lit("STATION "), (F.col("amenity_id") % 40).cast("string")).alias("station"),
        F.explode(parse_lines(F.col("lines_present_json"))).alias("line"),
    )
    out = A.lines_per_station(rows, "station", "line")
    return out.select("station", F.array_join("lines_present", ";").alias("lines"), "line_count")


@query("value_counts_pct", """SELECT coalesce(lease_text, 'Unknown') AS lease_text, count(*) AS count,
 round(count(*) / (SELECT count(*) FROM {f_messy} q), 6) AS pct FROM {f_messy} t GROUP BY 1""")
def value_counts_pct(t):
    return rounded(A.value_counts(t.f_messy, "lease_text"), {"pct"}, 6)


@query("distribution_with_price", """SELECT town, count(*) AS count, round(count(*) / (SELECT count(resale_price) FROM {f_txn} q), 6) AS pct,
 round(avg(resale_price), 6) AS mean_price, round(quantile_cont(resale_price, 0.5), 6) AS median_price FROM {f_txn} t WHERE resale_price IS NOT NULL GROUP BY town""")
def distribution_with_price(t):
    out = A.distribution_with_price(t.f_txn, "town")
    return rounded(rounded(out, {"pct"}, 6), {"mean_price", "median_price"})


_FACTORS = ("school_count_1km", "good_school_count_1km", "school_count_2km", "good_school_count_2km", "malls_within_10min_walk")


@query("factor_distributions", """WITH l AS (SELECT factor, CAST(value AS DOUBLE) AS value, resale_price FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS factor, {c} AS value, resale_price FROM {{f_feature}} f{i}" for i, c in enumerate(_FACTORS)
) + """) u WHERE resale_price IS NOT NULL AND value IS NOT NULL), n AS (SELECT factor, count(*) AS total FROM l GROUP BY factor)
 SELECT l.factor, l.value, count(*) AS count, round(count(*) / any_value(n.total), 6) AS pct, round(avg(resale_price), 6) AS mean_price,
 round(quantile_cont(resale_price, 0.5), 6) AS median_price FROM l JOIN n ON l.factor = n.factor GROUP BY 1, 2""")
def factor_distributions(t):
    out = A.factor_distributions(t.f_feature, list(_FACTORS))
    return rounded(rounded(out, {"pct"}, 6), {"mean_price", "median_price"})


def _quantiles(column, probs):
    return ", ".join(f"round(quantile_cont({column}, {p}), 6) AS {n}" for n, p in probs.items())


_P7 = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_P5 = {k: _P7[k] for k in ("median", "p10", "p25", "p75", "p90")}
_BASE = "count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max"


@query("price_stats", f"SELECT {_BASE.format(c=PRICE)}, {_quantiles(PRICE, _P7)} FROM {{f_txn}} t")
def price_stats(t):
    return rounded(A.price_stats(t.f_txn), {"mean", "std", *_P7})


@query("price_stats_by", f"SELECT flat_type, {_BASE.format(c=PRICE)}, {_quantiles(PRICE, _P5)} FROM {{f_txn}} t GROUP BY flat_type")
def price_stats_by(t):
    return rounded(A.price_stats_by(t.f_txn, "flat_type"), {"mean", "std", *_P5})


_SUMMARY = ("floor_area_sqm", "nearest_mall_walking_distance_m", "nearest_pcn_walking_distance_m")
_P3 = {"median": 0.5, "p25": 0.25, "p75": 0.75}


@query("numeric_summary", " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", {_BASE.format(c=c)}, {_quantiles(c, _P3)} FROM {{f_feature}} f{i}' for i, c in enumerate(_SUMMARY)
))
def numeric_summary(t):
    return rounded(A.numeric_summary(t.f_feature, list(_SUMMARY)), {"mean", "std", *_P3})


_CORR = ("resale_price", "school_count_1km", "good_school_count_1km", "floor_area_sqm", "nearest_pcn_walking_distance_m")


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM {{f_feature}} f{i}_{j}"
    for i, a in enumerate(_CORR) for j, b in enumerate(_CORR)
))
def correlation_matrix(t):
    return rounded(A.correlation_matrix(t.f_feature, list(_CORR)), {"corr"}, 6)


@query("monthly_trend", """SELECT month, count(resale_price) AS count, round(avg(resale_price), 6) AS mean_price,
 round(quantile_cont(resale_price, 0.5), 6) AS median_price FROM {f_txn} t WHERE resale_price IS NOT NULL GROUP BY month""")
def monthly_trend(t):
    return rounded(A.monthly_trend(t.f_txn), {"mean_price", "median_price"})


@query("postal_counts", """SELECT p AS postal_code, count(*) AS count FROM (SELECT trim(CASE WHEN ck % 9 = 0 THEN '  ' ELSE lpad(CAST(ck % 500 AS VARCHAR), 6, '0') END) AS p
 FROM {f_address} a) t WHERE length(p) > 0 GROUP BY 1""")
def postal_counts(t):
    code = F.when(F.col("ck") % 9 == 0, "  ").otherwise(F.lpad((F.col("ck") % 500).cast("string"), 6, "0"))
    return A.postal_counts(t.f_address.select(code.alias("POSTAL_COD")), "POSTAL_COD")


@query("town_good_schools", f"""WITH g AS (SELECT address_key, boundary_school_name FROM {_NEAR} n WHERE is_good_school AND d < 15000),
 c AS (SELECT address_key, town, count(*) AS n FROM {{f_txn}} x GROUP BY 1, 2)
 SELECT c.town, g.boundary_school_name AS school_name, count(DISTINCT g.address_key) AS address_count, CAST(sum(c.n) AS BIGINT) AS transaction_count
 FROM g JOIN c ON g.address_key = c.address_key GROUP BY 1, 2""")
def town_good_schools(t):
    near = near_schools(t).withColumns({
        "inside_good_school_1km": (F.col("d") < 15000).cast("int"),
        "boundary_school_join_key": F.lower("boundary_school_name"),
    })
    good = t.f_school.where("is_good_school").select(F.col("school_name").alias("join_key"))
    return A.town_good_schools(t.f_txn, near, good)


@query("rdd_coverage", f"""WITH r AS (SELECT boundary_school_name, school_group, count(*) AS n FROM {RESULTS} a WHERE p_value < 0.5 GROUP BY 1, 2),
 s AS (SELECT boundary_school_name, school_group, count(*) AS n FROM {RESULTS} b WHERE p_value >= 0.8 GROUP BY 1, 2)
 SELECT coalesce(r.boundary_school_name, s.boundary_school_name) AS boundary_school_name, coalesce(r.school_group, s.school_group) AS school_group,
 coalesce(r.n, 0) AS result_rows, coalesce(s.n, 0) AS skipped_rows, coalesce(r.n, 0) > 0 AS has_results
 FROM r FULL JOIN s ON r.boundary_school_name = s.boundary_school_name AND r.school_group = s.school_group""")
def rdd_coverage(t):
    rows = result_rows(t)
    return A.result_coverage(rows.where("p_value < 0.5"), rows.where("p_value >= 0.8"))


@query("premium_summary", f"""SELECT count(*) AS count, round(avg(cutoff_premium_pct), 6) AS mean_premium_pct, round(quantile_cont(cutoff_premium_pct, 0.5), 6) AS median_premium_pct,
 round(avg(p_value * 1000), 6) AS mean_premium_sgd, round(quantile_cont(p_value * 1000, 0.5), 6) AS median_premium_sgd,
 (SELECT count(*) FROM {RESULTS} q WHERE p_value >= 0.5) AS skipped_town_count FROM {RESULTS} r WHERE p_value < 0.5""")
def premium_summary(t):
    rows = result_rows(t).withColumn("money", F.col("p_value") * 1000)
    out = A.premium_summary(rows.where("p_value < 0.5"), rows.where("p_value >= 0.5"), "cutoff_premium_pct", "money")
    return rounded(out, {c for c in out.columns if c.startswith("m")}, 6)


def _best(metric, direction=""):
    return f"""SELECT * FROM (SELECT '{metric}' AS best_by, boundary_school_name, bandwidth_m, cutoff_premium_pct, p_value
 FROM (SELECT *, boundary_school_name || '/' || CAST(bandwidth_m AS VARCHAR) AS k FROM {RESULTS} r) t ORDER BY {metric} {direction}, k LIMIT 1)"""


@query("best_rows", _best("cutoff_premium_pct", "DESC") + " UNION ALL " + _best("p_value"))
def best_rows(t):
    rows = result_rows(t).withColumn("k", F.concat_ws("/", "boundary_school_name", F.col("bandwidth_m").cast("string")))
    out = A.best_rows(rows, {"cutoff_premium_pct": "max", "p_value": "min"}, tie="k")
    return out.select("best_by", "boundary_school_name", "bandwidth_m", "cutoff_premium_pct", "p_value")


_MEDIANS = ("floor_area_sqm", "lease_commence_date", "nearest_mall_walking_distance_m", "nearest_pcn_walking_distance_m", "school_count_1km", "parks_within_5min_walk")
_MODES = ("month", "town", "flat_type", "flat_model")


@query("profile_defaults", " UNION ALL ".join(
    [f'SELECT \'{c}\' AS "column", CAST(round(quantile_cont({c}, 0.5), 6) AS DOUBLE) AS median, NULL AS mode FROM {{f_feature}} f{i}' for i, c in enumerate(_MEDIANS)]
    + [f"""SELECT '{c}', NULL, {c} FROM (SELECT {c}, count(*) AS n FROM {{f_feature}} g{i} GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1) t{i}""" for i, c in enumerate(_MODES)]
))
def profile_defaults(t):
    return rounded(A.profile(t.f_feature, list(_MEDIANS), list(_MODES)), {"median"}, 6)


_TEXTS = ("month", "town", "flat_type", "flat_model")
_NUMBERS = [c for c in FALLBACK_NUMBER if c not in ("lease_commence_date", "remaining_lease_years", "storey_mid")]
_LEASE = """CASE WHEN remaining_lease IS NOT NULL THEN coalesce(try_cast(regexp_extract(remaining_lease, '(\\d+)\\s+year', 1) AS INTEGER), 0)
 + coalesce(try_cast(regexp_extract(remaining_lease, '(\\d+)\\s+month', 1) AS INTEGER), 0) / 12.0 END"""


@query("prediction_defaults", f"""WITH f AS MATERIALIZED (SELECT *, {_LEASE} AS lease,
  (CAST(substr(storey_range, 1, 2) AS DOUBLE) + CAST(substr(storey_range, 7, 2) AS DOUBLE)) / 2 AS storey FROM {{f_feature}} t),
 m AS (SELECT greatest(CAST(round_even(quantile_cont(lease, 0.5), 0) AS INTEGER), 1) AS years,
  greatest(CAST(floor(quantile_cont(storey, 0.5) - 1) AS INTEGER), 1) AS low, CAST(ceil(quantile_cont(storey, 0.5) + 1) AS INTEGER) AS high,
  CAST(round_even(quantile_cont(lease_commence_date, 0.5), 0) AS INTEGER) AS built FROM f)
 """ + " UNION ALL ".join(
    [f"(SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM f WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in _TEXTS]
    + [f"SELECT '{c}', CAST(CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS VARCHAR) FROM f" for c in _NUMBERS]
    + ["SELECT 'lease_commence_date', CAST(built AS VARCHAR) FROM m", "SELECT 'remaining_lease', years || ' years' FROM m",
       "SELECT 'storey_range', lpad(CAST(low AS VARCHAR), 2, '0') || ' TO ' || lpad(CAST(greatest(high, low) AS VARCHAR), 2, '0') FROM m"]))
def prediction_defaults_query(t):
    """The full set of prediction defaults as text, one row per input."""
    defaults = prediction_defaults(t.f_feature)
    rows = [(k, str(v)) for k, v in sorted(defaults.items())]
    return t.spark.createDataFrame(rows, "field string, value string")


@query("domain_values", " UNION ALL ".join(
    f'SELECT DISTINCT \'{c}\' AS "column", {c} AS value FROM {{f_txn}} f{i}' for i, c in enumerate(("town", "flat_type", "flat_model"))
))
def domain_values(t):
    return A.domain_values(t.f_txn, ["town", "flat_type", "flat_model"])


@query("dataset_metadata", """SELECT 'sales' AS table_name, count(*) AS rows FROM {f_txn} a UNION ALL SELECT 'addresses', count(*) FROM {f_address} b
 UNION ALL SELECT 'amenities', count(*) FROM {f_amenity} c UNION ALL SELECT 'schools', count(*) FROM {f_school} d""")
def dataset_metadata(t):
    return A.table_counts({"sales": t.f_txn, "addresses": t.f_address, "amenities": t.f_amenity, "schools": t.f_school})


@query("names_concat", f"""SELECT address_key, coalesce(string_agg(DISTINCT boundary_school_name, ', ' ORDER BY boundary_school_name), '') AS names FROM {_NEAR} t GROUP BY 1""")
def names_concat(t):
    return A.names_concat(near_schools(t), "address_key", "boundary_school_name", "names")


@query("treated_share", """SELECT town, count(*) AS rows, round(avg(CASE WHEN good_school_count_1km > 0 AND txn_id % 13 <> 0 THEN 1 ELSE 0 END), 6) AS treated_share FROM {f_txn} t GROUP BY town""")
def treated_share(t):
    sales = t.f_txn.withColumn("good", F.when(F.col("txn_id") % 13 != 0, F.col("good_school_count_1km")))
    return rounded(A.treated_share(sales, "town", "good"), {"treated_share"}, 6)


def scored(t):
    """Sales with the stand-in prediction, its error and the exposure flag."""
    return priced(t).withColumns({
        "prediction_error": F.col(PRICE) - F.col("predicted_resale_price"),
        "good_school_within_1km": (F.col("good_school_count_1km") > 0).cast("int"),
    })


_SCORED = """(SELECT *, floor_area_sqm * 5000 AS p, resale_price - floor_area_sqm * 5000 AS e, CAST(good_school_count_1km > 0 AS INTEGER) AS g FROM {f_txn} s)"""


@query("map_summary", f"""SELECT count(*) AS rows, count(DISTINCT town) AS town_count, round(avg(resale_price), 6) AS avg_actual, round(avg(e), 6) AS mean_error,
 round(avg(abs(e)), 6) AS mean_abs_error, round(avg(g), 6) AS good_school_share, round(avg(p), 6) AS avg_predicted, round(quantile_cont(p, 0.5), 6) AS median_predicted FROM {_SCORED} t""")
def map_summary(t):
    out = A.map_summary(scored(t))
    return rounded(rounded(out, {"good_school_share"}, 6), {"avg_actual", "mean_error", "mean_abs_error", "avg_predicted", "median_predicted"})


_CMP = "count(*) AS listings, round(avg(p), 6) AS avg_predicted, round(avg(resale_price), 6) AS avg_actual, round(avg(e), 6) AS avg_error, round(avg(g), 6) AS near_good_school_share"
_MONEY = {"avg_predicted", "avg_actual", "avg_error"}


@query("map_top_towns", f"SELECT town, {_CMP} FROM {_SCORED} t GROUP BY town ORDER BY avg(p) DESC, listings DESC, town LIMIT 8")
def map_top_towns(t):
    return rounded(rounded(A.top_groups(scored(t), "town", 8), {"near_good_school_share"}, 6), _MONEY)


@query("map_exposure_comparison", f"SELECT g AS good_school_within_1km, {_CMP.replace(', round(avg(g), 6) AS near_good_school_share', '')} FROM {_SCORED} t GROUP BY g")
def map_exposure_comparison(t):
    return rounded(A.group_comparison(scored(t), "good_school_within_1km").drop("near_good_school_share"), _MONEY)


@query("exposure_gap", f"""WITH s AS (SELECT * FROM {_SCORED} q), m AS (SELECT town, avg(p) AS a FROM s WHERE strpos('HOW DO NATION_12, NATION_6X AND NATION_18! COMPARE?', town) > 0 GROUP BY town)
 SELECT round(avg(p) FILTER (WHERE g = 1), 6) AS mean_near, round(avg(p) FILTER (WHERE g = 0), 6) AS mean_far,
 round(avg(p) FILTER (WHERE g = 1) - avg(p) FILTER (WHERE g = 0), 6) AS gap, (SELECT town FROM m ORDER BY a DESC, town LIMIT 1) AS top_town,
 round((SELECT max(a) FROM m), 6) AS top_town_mean FROM s""")
def exposure_gap(t):
    out = A.exposure_gap(scored(t), towns_in_text="how do nation_12, Nation_6x and Nation_18! compare?")
    return rounded(out, {"mean_near", "mean_far", "gap", "top_town_mean"})


@query("extent", """SELECT min(x) - 100 AS min_x, min(y) - 100 AS min_y, max(x) + 100 AS max_x, max(y) + 100 AS max_y FROM {f_address} t""")
def extent(t):
    return A.extent(t.f_address, "x", "y", margin=100)


@query("histogram_bins", """WITH v AS (SELECT resale_price AS x FROM {f_txn} q WHERE resale_price IS NOT NULL), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 80 AS w FROM v),
 b AS (SELECT CAST(unnest(range(80)) AS INTEGER) AS bin), c AS (SELECT least(79, CAST(floor((x - lo) / w) AS INTEGER)) AS bin, count(*) AS n FROM v, e GROUP BY 1)
 SELECT b.bin, round(lo + b.bin * w, 6) AS bin_low, round(lo + (b.bin + 1) * w, 6) AS bin_high, coalesce(n, 0) AS count FROM b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""")
def histogram_bins(t):
    return rounded(A.histogram(t.f_txn, PRICE, 80), {"bin_low", "bin_high"})


@query("box_stats", """WITH v AS (SELECT flat_type, resale_price AS x FROM {f_txn} q WHERE resale_price IS NOT NULL),
 b AS (SELECT flat_type, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1)
 SELECT b.flat_type, any_value(n) AS count, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
 min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)) AS whisker_high
 FROM b JOIN v ON b.flat_type = v.flat_type GROUP BY b.flat_type""")
def box_stats(t):
    return rounded(A.box_stats(t.f_txn, "flat_type", PRICE), {"q1", "median", "q3"})
