"""Filters, lookups, limits, ordering, ranking and unions."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import filters as P, ordering as O
from ..operators.schools import rank_schools
from .registry import query, r6

_COLS = "txn_id, town, flat_type, month, floor_area_sqm, resale_price"
COLS = _COLS.split(", ")


@query("filter_in_ci", f"SELECT {_COLS} FROM {{f_txn}} t WHERE upper(town) IN ('NATION_6','NATION_18') AND upper(flat_type) IN ('1-URGENT')")
def filter_in_ci(t):
    return P.filter_sales(t.f_txn, town=["nation_6", "Nation_18"], flat_type=["1-urgent"]).select(*COLS)


@query("filter_month_in", f"SELECT {_COLS} FROM {{f_txn}} t WHERE month IN ('1996-02','1998-11')")
def filter_month_in(t):
    return P.filter_sales(t.f_txn, month=["1996-02", "1998-11"]).select(*COLS)


@query("filter_month_range", f"SELECT {_COLS} FROM {{f_txn}} t WHERE month BETWEEN '1996-02' AND '1997-01'")
def filter_month_range(t):
    return P.filter_sales(t.f_txn, month_from="1996-02", month_to="1997-01").select(*COLS)


@query("filter_numeric_range", f"SELECT {_COLS} FROM {{f_txn}} t WHERE floor_area_sqm >= 0 AND floor_area_sqm <= 90 AND resale_price >= 100000 AND lease_commence_date <= 1980")
def filter_numeric_range(t):
    return P.filter_sales(
        t.f_txn, min_floor_area_sqm=0, max_floor_area_sqm=90, min_resale_price=100000, max_lease_commence_date=1980
    ).select(*COLS)


@query("filter_compose", f"""SELECT {_COLS} FROM {{f_txn}} t WHERE upper(flat_model) IN ('BUILDING','MACHINERY') AND upper(storey_range) IN ('01 TO 03','04 TO 06')
 AND upper(street_name) = 'STREET 3' AND month >= '1996-01' AND resale_price <= 400000""")
def filter_compose(t):
    return P.filter_sales(
        t.f_txn, town=[], flat_model=["building", "machinery"], storey_range=["01 to 03", "04 TO 06"],
        street_name=["street 3"], month_from="1996-01", max_resale_price=400000,
    ).select(*COLS)


@query("filter_contains_ci", f"SELECT {_COLS} FROM {{f_txn}} t WHERE upper(town) LIKE '%ION_1%' AND regexp_matches(lower(flat_model), 'mach|build')")
def filter_contains_ci(t):
    return t.f_txn.where(
        P.contains_ci("town", "ion_1") & P.contains_ci("flat_model", "mach|BUILD".lower(), regex=True)
    ).select(*COLS)


@query("lookup_eq_ci", "SELECT school_id, school_name, is_good_school FROM {f_school} t WHERE lower(school_name) = 'nation_12'")
def lookup_eq_ci(t):
    return P.lookup_ci(t.f_school.select("school_id", "school_name", "is_good_school"), "school_name", "Nation_12")


def result_rows(t):
    """A result table in the form of the boundary study: one row per town and bandwidth."""
    towns = t.nation.select(
        F.col("n_name").alias("town"), F.col("n_nationkey").alias("k"),
    )
    per_town = t.f_txn.groupBy("town").agg(F.count("*").alias("sample_size"))
    bands = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(100 * (i + 1)).alias("h")) for i in range(5)])
    rows = towns.join(per_town, "town").withColumn("b", F.explode(bands))
    return rows.select(
        F.col("town").alias("boundary_school_name"),
        F.when(F.col("k") % 4 == 0, "good").otherwise("non_good").alias("school_group"),
        F.col("b.h").cast("long").alias("bandwidth_m"),
        F.when(F.col("b.s") == 0, "uncontrolled").otherwise("controlled").alias("specification"),
        "sample_size",
        F.round((F.col("k") % 7 - 3) / 100 + F.col("b.h") / 100000, 6).alias("cutoff_premium_pct"),
        F.round(((F.col("k") * 37 + F.col("b.h")) % 100) / 100, 6).alias("p_value"),
    )


RESULTS = """(SELECT n.n_name AS boundary_school_name, CASE WHEN n.n_nationkey % 4 = 0 THEN 'good' ELSE 'non_good' END AS school_group,
 CAST(100 * (b.s + 1) AS BIGINT) AS bandwidth_m, CASE WHEN b.s = 0 THEN 'uncontrolled' ELSE 'controlled' END AS specification, p.sample_size,
 round((n.n_nationkey % 7 - 3) / 100.0 + (100 * (b.s + 1)) / 100000.0, 6)::DOUBLE AS cutoff_premium_pct,
 round(((n.n_nationkey * 37 + 100 * (b.s + 1)) % 100) / 100.0, 6)::DOUBLE AS p_value
 FROM nation n JOIN (SELECT town, count(*) AS sample_size FROM {f_txn} x GROUP BY town) p ON p.town = n.n_name
 CROSS JOIN (SELECT unnest([0,1,2,3,4]) AS s) b)"""


@query("filter_rdd_results", f"""SELECT * FROM {RESULTS} r WHERE lower(school_group) = 'good' AND lower(specification) = 'controlled'
 AND bandwidth_m = 200 ORDER BY boundary_school_name LIMIT 50""")
def filter_rdd_results(t):
    hits = P.filter_results(result_rows(t), group="Good", specification="CONTROLLED", bandwidth=200)
    return hits.orderBy("boundary_school_name").limit(50)


@query("filter_significant", f"SELECT * FROM {RESULTS} r WHERE p_value < 0.05 AND p_value BETWEEN 0.0 AND 0.04")
def filter_significant(t):
    return result_rows(t).where(P.significant("p_value", low=0.0, high=0.04, alpha=0.05))


@query("drop_nulls", f"SELECT {_COLS} FROM {{f_txn}} t WHERE resale_price IS NOT NULL AND remaining_lease IS NOT NULL")
def drop_nulls(t):
    return t.f_txn.dropna(subset=["resale_price", "remaining_lease"]).select(*COLS)


@query("filter_primary_level", """SELECT id, school_text FROM {f_messy} t WHERE upper(school_text) LIKE '%PRIMARY%' AND id % 6 IN (0, 1, 4)""")
def filter_primary_level(t):
    m = t.f_messy.withColumn("lat", F.col("number_text"))
    return P.primary_level(m, "school_text", "lat", "number_text").select("id", "school_text")


@query("filter_bandwidth", """SELECT txn_id, CAST(h AS DOUBLE) AS bandwidth_m FROM {f_txn} t CROSS JOIN (SELECT unnest([10, 20, 50]) AS h) b
 WHERE abs(floor_area_sqm - 90) <= h""")
def filter_bandwidth(t):
    d = t.f_txn.select("txn_id", (F.col("floor_area_sqm") - 90).alias("d"))
    return P.explode_bandwidths(d, "d", [10, 20, 50]).select("txn_id", "bandwidth_m")


@query("route_by_threshold", """WITH g AS (SELECT town, count(*) AS rows, round(avg(CAST(good_school_count_1km > 2 AS INTEGER)), 6) AS treated_share FROM {f_txn} x GROUP BY town),
 m AS (SELECT avg(rows) AS a FROM g)
 SELECT town, rows, treated_share, CASE WHEN rows >= (SELECT a FROM m) AND treated_share >= 0.05 THEN 'fit' ELSE 'below_threshold' END AS reason FROM g""")
def route_by_threshold(t):
    groups = t.f_txn.groupBy("town").agg(
        F.count("*").alias("rows"),
        F.round(F.avg((F.col("good_school_count_1km") > 2).cast("int")), 6).alias("treated_share"),
    )
    least = groups.select(F.avg("rows")).scalar()
    fit, skipped = P.route_by_threshold(
        groups, (F.col("rows") >= least) & (F.col("treated_share") >= 0.05), "below_threshold"
    )
    return fit.withColumn("reason", F.lit("fit")).unionByName(skipped)


@query("resale_rows", f"""SELECT {_COLS} FROM {{f_txn}} t WHERE upper(town) = 'NATION_12' AND resale_price >= 200000 ORDER BY txn_id LIMIT 1000""")
def resale_rows(t):
    return P.filter_sales(t.f_txn, town=["nation_12"], min_resale_price=200000).select(*COLS).orderBy("txn_id").limit(1000)


@query("multi_key_sort", """SELECT town, flat_type, count(*) AS n, round(avg(resale_price), 4) AS mean_price FROM {f_txn} t GROUP BY 1, 2 ORDER BY town, n DESC, flat_type""")
def multi_key_sort(t):
    g = t.f_txn.groupBy("town", "flat_type").agg(F.count("*").alias("n"), r6(F.avg("resale_price"), "mean_price", 4))
    return g.orderBy(F.asc("town"), F.desc("n"), F.asc("flat_type"))


@query("dedup_keep_first", f"""SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY address_key ORDER BY month, txn_id) AS rn FROM {{f_txn}} x) t WHERE rn = 1""")
def dedup_keep_first(t):
    return O.first_per_key(t.f_txn, ["address_key"], [F.col("month"), F.col("txn_id")]).select(*COLS)


_PART = r"try_cast(regexp_extract({c}, '^\s*(\d+)\s*/\s*(\d+)\s*$', {g}) AS BIGINT)"
_SUMS = " UNION ALL ".join(
    f"SELECT school_id, name, {_PART.format(c=c, g=1)} AS a, {_PART.format(c=c, g=2)} AS v FROM {{f_ratio}} r{i}"
    for i, c in enumerate(("phase_2a", "phase_2b", "phase_2c", "phase_2c_sup"))
)


@query("rank_top_n", f"""SELECT school_id, name, applicants_total, vacancies_total, round(s, 6) AS overall_subscription_rates,
 row_number() OVER (ORDER BY s DESC, applicants_total DESC, name) AS rank,
 row_number() OVER (ORDER BY s DESC, applicants_total DESC, name) <= 59 AS is_good_school,
 CASE WHEN row_number() OVER (ORDER BY s DESC, applicants_total DESC, name) <= 59 THEN 'Good' ELSE 'Normal' END AS school_tier
 FROM (SELECT school_id, name, CAST(sum(a) AS BIGINT) AS applicants_total, CAST(sum(v) AS BIGINT) AS vacancies_total, sum(a) / sum(v) AS s
  FROM ({_SUMS}) u WHERE v > 0 GROUP BY 1, 2) t""")
def rank_top_n(t):
    phases = ["phase_2a", "phase_2b", "phase_2c", "phase_2c_sup"]
    return rank_schools(t.f_ratio, "name", phases, top_n=59).select(
        "school_id", "name", "applicants_total", "vacancies_total",
        r6("overall_subscription_rates", "overall_subscription_rates"), "rank", "is_good_school", "school_tier",
    )


@query("limit", f"SELECT {_COLS} FROM {{f_txn}} t ORDER BY txn_id LIMIT 50")
def limit(t):
    return t.f_txn.select(*COLS).orderBy("txn_id").limit(50)


@query("top_groups", """SELECT town, count(*) AS listings, round(avg(floor_area_sqm * 5000), 4) AS avg_predicted FROM {f_txn} t
 GROUP BY town ORDER BY avg(floor_area_sqm * 5000) DESC, listings DESC, town LIMIT 8""")
def top_groups(t):
    g = t.f_txn.groupBy("town").agg(F.count("*").alias("listings"), F.avg(F.col("floor_area_sqm") * 5000).alias("m"))
    return g.orderBy(F.desc("m"), F.desc("listings"), "town").limit(8).select(
        "town", "listings", r6("m", "avg_predicted", 4)
    )


@query("dedup_largest_area", """SELECT ck, town, area FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY area DESC, ck) AS rn
 FROM (SELECT ck, town, x * y AS area, CASE WHEN ck % 10 = 0 THEN NULL ELSE ck % 97 END AS object_id FROM {f_address} a) q) t WHERE rn = 1 OR object_id IS NULL""")
def dedup_largest_area(t):
    a = t.f_address.select(
        "ck", "town", (F.col("x") * F.col("y")).alias("area"),
        F.when(F.col("ck") % 10 != 0, F.col("ck") % 97).alias("object_id"),
    )
    return O.largest_per_id(a, "object_id", "area", "ck").select("ck", "town", "area")


@query("sample_n", f"""SELECT {', '.join(COLS)} FROM {{f_txn}} t ORDER BY md5('42:' || CAST(txn_id AS VARCHAR)), txn_id LIMIT 1000""")
def sample_n(t):
    """A repeatable sample of 1,000 sales."""
    return O.sample_n(t.f_txn.select(*COLS), 1000, ["txn_id"], seed=42)


@query("union_all", """SELECT amenity_id AS id, amenity_name AS name, kind, CAST(NULL AS BOOLEAN) AS good FROM {f_amenity} a
 UNION ALL SELECT CAST(school_id AS BIGINT), school_name, NULL, is_good_school FROM {f_school} s""")
def union_all(t):
    a = t.f_amenity.select(F.col("amenity_id").alias("id"), F.col("amenity_name").alias("name"), "kind")
    s = t.f_school.select(
        F.col("school_id").cast("long").alias("id"), F.col("school_name").alias("name"), F.col("is_good_school").alias("good")
    )
    return a.unionByName(s, allowMissingColumns=True)
