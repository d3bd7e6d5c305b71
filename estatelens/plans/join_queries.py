"""Equi-joins by address, key and name."""

from pyspark.sql import functions as F

from ..operators.rdd import mean_premium
from .filter_queries import RESULTS, result_rows
from .registry import query, r6


@query("join_inner", """SELECT t.txn_id, a.x, a.y, a.latitude, a.longitude FROM {f_txn} t JOIN {f_address} a ON t.address_key = a.address_key""")
def join_inner(t):
    return t.f_txn.join(t.f_address, "address_key").select("txn_id", "x", "y", "latitude", "longitude")


@query("join_left", """SELECT t.txn_id, s.is_good_school, s.h FROM {f_txn} t LEFT JOIN (SELECT * FROM {f_school} q WHERE h > 100) s ON t.town = s.school_name""")
def join_left(t):
    s = t.f_school.where(F.col("h") > 100)
    return t.f_txn.join(s, F.col("town") == F.col("school_name"), "left").select("txn_id", "is_good_school", "h")


@query("join_full_outer", """WITH a AS (SELECT town, flat_type, count(*) AS n FROM {f_txn} x WHERE month < '1997-01' AND flat_type < '4' GROUP BY 1, 2),
 b AS (SELECT town, flat_type, count(*) AS m FROM {f_txn} y WHERE flat_type > '2' GROUP BY 1, 2)
 SELECT coalesce(a.town, b.town) AS town, coalesce(a.flat_type, b.flat_type) AS flat_type, coalesce(n, 0) AS result_rows, coalesce(m, 0) AS skipped_rows
 FROM a FULL JOIN b ON a.town = b.town AND a.flat_type = b.flat_type""")
def join_full_outer(t):
    keys = ["town", "flat_type"]
    a = t.f_txn.where((F.col("month") < "1997-01") & (F.col("flat_type") < "4")).groupBy(*keys).agg(F.count("*").alias("n"))
    b = t.f_txn.where(F.col("flat_type") > "2").groupBy(*keys).agg(F.count("*").alias("m"))
    return a.join(b, keys, "full").select(
        *keys, F.coalesce("n", F.lit(0)).alias("result_rows"), F.coalesce("m", F.lit(0)).alias("skipped_rows")
    )


@query("join_semi", """SELECT txn_id, town FROM {f_txn} t WHERE town IN (SELECT school_name FROM {f_school} s WHERE is_good_school)""")
def join_semi(t):
    good = t.f_school.where("is_good_school").select(F.col("school_name").alias("town"))
    return t.f_txn.join(good, "town", "left_semi").select("txn_id", "town")


_NEAR = """(SELECT a.address_key, s.school_id, s.school_name AS boundary_school_name, s.is_good_school, abs(a.x - s.cx) + abs(a.y - s.cy) AS d
 FROM {f_address} a JOIN {f_school} s ON a.ck % 25 = s.school_id OR (a.ck + 7) % 25 = s.school_id)"""


def near_schools(t):
    """Each address with two schools and its block distance to them."""
    a = t.f_address.withColumn(
        "school_id", F.explode(F.array((F.col("ck") % 25).cast("int"), ((F.col("ck") + 7) % 25).cast("int")))
    )
    s = t.f_school.withColumnRenamed("school_name", "boundary_school_name")
    return a.join(s, "school_id").select(
        "address_key", "school_id", "boundary_school_name", "is_good_school",
        (F.abs(F.col("x") - F.col("cx")) + F.abs(F.col("y") - F.col("cy"))).alias("d"),
    )


@query("join_many_many", f"""SELECT t.txn_id, n.school_id, n.d FROM {{f_txn}} t JOIN {_NEAR} n ON t.address_key = n.address_key""")
def join_many_many(t):
    return t.f_txn.join(near_schools(t), "address_key").select("txn_id", "school_id", "d")


@query("lookup_map_join", f"""WITH p AS (SELECT boundary_school_name AS k, cutoff_premium_pct AS v FROM {RESULTS} r WHERE specification = 'controlled' AND bandwidth_m = 200),
 f AS (SELECT ck, town || ', ' || lower(street) || ',nowhere' AS names FROM (SELECT ck, town, CASE WHEN ck % 2 = 0 THEN 'nation_12' ELSE 'none' END AS street FROM {{f_address}} a) q),
 e AS (SELECT ck, upper(trim(unnest(string_split(names, ',')))) AS n FROM f)
 SELECT f.ck, round(m.v, 6) AS school_rdd_premium_pct FROM f LEFT JOIN (SELECT ck, avg(v) AS v FROM e JOIN p ON e.n = p.k GROUP BY ck) m ON f.ck = m.ck""")
def lookup_map_join(t):
    flats = t.f_address.select(
        "ck",
        F.concat("town", F.lit(", "), F.when(F.col("ck") % 2 == 0, "nation_12").otherwise("none"), F.lit(",nowhere")).alias("names"),
    )
    premiums = result_rows(t).where((F.col("specification") == "controlled") & (F.col("bandwidth_m") == 200))
    out = mean_premium(flats, "ck", "names", premiums.select("boundary_school_name", "cutoff_premium_pct"))
    return out.select("ck", r6("school_rdd_premium_pct", "school_rdd_premium_pct"))
