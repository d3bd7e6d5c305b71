"""Sample views: the given tables read as sales, addresses, amenities, schools and streets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_SOURCE = re.compile(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b")

_TXN = """SELECT o.o_orderkey AS txn_id, substr(CAST(o.o_orderdate AS STRING),1,7) AS month, n.n_name AS town,
 o.o_orderpriority AS flat_type, c.c_mktsegment AS flat_model, CAST(c.c_custkey % 40 AS STRING) AS block,
 'STREET ' || CAST(c.c_custkey % 7 AS STRING) AS street_name,
 lpad(CAST(1 + 3 * (o.o_orderkey % 10) AS STRING),2,'0') || ' TO ' || lpad(CAST(3 + 3 * (o.o_orderkey % 10) AS STRING),2,'0') AS storey_range,
 CAST(31 + (o.o_orderkey * 17) % 120 AS DOUBLE) AS floor_area_sqm,
 CAST(1966 + c.c_custkey % 29 AS INT) AS lease_commence_date,
 CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderkey % 5 = 0 THEN CAST(60 + c.c_custkey % 29 AS STRING) || ' years'
      ELSE CAST(60 + c.c_custkey % 29 AS STRING) || ' years ' || lpad(CAST(o.o_orderkey % 12 AS STRING),2,'0') || ' months' END AS remaining_lease,
 CASE WHEN o.o_orderkey % 101 = 0 THEN NULL ELSE o.o_totalprice END AS resale_price,
 n.n_name || '|' || CAST(c.c_custkey % 40 AS STRING) || '|' || 'STREET ' || CAST(c.c_custkey % 7 AS STRING) AS address_key,
 CAST(c.c_custkey % 4 AS INT) AS good_school_count_1km, CAST(c.c_custkey % 4 + c.c_custkey % 3 AS INT) AS school_count_1km
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""

_ADDRESS = """SELECT address_key, town, ck, CAST((ck * 7919) % 20000 AS DOUBLE) AS x, CAST((ck * 104729) % 20000 AS DOUBLE) AS y,
 1.25 + CAST((ck * 104729) % 20000 AS DOUBLE) / 111320 AS latitude, 103.6 + CAST((ck * 7919) % 20000 AS DOUBLE) / 111320 AS longitude
FROM (SELECT n.n_name || '|' || CAST(c.c_custkey % 40 AS STRING) || '|' || 'STREET ' || CAST(c.c_custkey % 7 AS STRING) AS address_key,
  n.n_name AS town, min(c.c_custkey) AS ck FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2) t"""

_AMENITY = """SELECT s_suppkey AS amenity_id, s_name AS amenity_name, CAST(s_suppkey % 5 AS INT) AS kind,
 CAST((s_suppkey * 6101 + 137) % 20000 AS DOUBLE) AS x, CAST((s_suppkey * 9973 + 59) % 20000 AS DOUBLE) AS y,
 '["L' || CAST(s_suppkey % 6 AS STRING) || '","L' || CAST(s_suppkey % 4 AS STRING) || '"]' AS lines_present_json,
 1.25 + CAST((s_suppkey * 9973 + 59) % 20000 AS DOUBLE) / 111320 AS latitude,
 103.6 + CAST((s_suppkey * 6101 + 137) % 20000 AS DOUBLE) / 111320 AS longitude FROM supplier"""

_SCHOOL = """SELECT n_nationkey AS school_id, n_name AS school_name, n_nationkey % 4 = 0 AS is_good_school,
  CAST((n_nationkey * 4801 + 1000) % 20000 AS DOUBLE) AS cx, CAST((n_nationkey * 7103 + 1500) % 20000 AS DOUBLE) AS cy,
  CAST(60 + 5 * n_nationkey AS DOUBLE) AS h FROM nation"""


def _squares(source: str, keys: str, part: int = 0, dx: str = "0") -> str:
    """Edge table of axis-parallel squares of half-width h about (cx, cy)."""
    sides = ((1, -1, -1, 1, -1), (2, 1, -1, 1, 1), (3, 1, 1, -1, 1), (4, -1, 1, -1, -1))
    return " UNION ALL ".join(
        f"SELECT {keys}, {part} AS part, {seq} AS seq, cx + {dx} + h * {ax} AS x1, cy + h * {ay} AS y1,"
        f" cx + {dx} + h * {bx} AS x2, cy + h * {by} AS y2 FROM ({source}) s{part}_{seq}"
        for seq, ax, ay, bx, by in sides
    )


# Building outlines: one square of 30 to 70 m about every address point, plus block numbers.
_BUILDING_CENTRE = f"""SELECT ck AS building_id, split_part(address_key, '|', 2) AS block_no,
 lpad(CAST(ck % 500 AS STRING), 6, '0') AS postal_code, x AS cx, y AS cy, CAST(15 + ck % 21 AS DOUBLE) AS h
 FROM ({_ADDRESS}) a"""

VIEW_SQL: dict[str, str] = {
    "f_txn": _TXN,
    "f_address": _ADDRESS,
    "f_amenity": _AMENITY,
    "f_school": _SCHOOL,
    "f_school_edge": _squares(_SCHOOL, "school_id, school_name, is_good_school"),
    # 1 km square areas about the schools, in place of rounded buffers.
    "f_area_edge": _squares(
        f"SELECT school_id, school_name, is_good_school, cx, cy, h + 1000 AS h FROM ({_SCHOOL}) b",
        "school_id, school_name, is_good_school",
    ),
    # Schools in two parts: the outline, and a smaller one 400 m to the east.
    "f_parts_edge": _squares(_SCHOOL, "school_id, school_name") + " UNION ALL " + _squares(
        f"SELECT school_id, school_name, cx, cy, h / 2 AS h FROM ({_SCHOOL}) b",
        "school_id, school_name", part=1, dx="400",
    ),
    "f_building": _BUILDING_CENTRE,
    "f_building_edge": _squares(_BUILDING_CENTRE, "building_id, block_no, postal_code"),
    # Walking network over all customers, undirected; sources are the suppliers' nodes.
    "f_edge": """SELECT c_custkey AS src, c_custkey + 1 AS dst, CAST(50 + (c_custkey * 37) % 200 AS DOUBLE) AS length FROM customer
 UNION ALL SELECT c_custkey + 1, c_custkey, CAST(50 + (c_custkey * 37) % 200 AS DOUBLE) FROM customer
 UNION ALL SELECT c_custkey, c_custkey + 30, CAST(50 + (c_custkey * 53) % 200 AS DOUBLE) FROM customer
 UNION ALL SELECT c_custkey + 30, c_custkey, CAST(50 + (c_custkey * 53) % 200 AS DOUBLE) FROM customer""",
    "f_source": """SELECT s_suppkey AS source_id, s_name AS source_name, s_suppkey * 15 AS node,
 'STATION ' || CAST(s_suppkey % 40 AS STRING) AS station,
 '["L' || CAST(s_suppkey % 6 AS STRING) || '","L' || CAST(s_suppkey % 4 AS STRING) || '"]' AS lines_present_json FROM supplier""",
    "f_ratio": """SELECT s_suppkey AS school_id, s_name AS name,
 CAST(20 + s_suppkey % 60 AS STRING) || '/' || CAST(30 + s_suppkey % 40 AS STRING) AS phase_2a,
 CASE WHEN s_suppkey % 3 = 0 THEN 'N/A' ELSE CAST(s_suppkey % 25 AS STRING) || ' / ' || CAST(20 + s_suppkey % 20 AS STRING) END AS phase_2b,
 CASE WHEN s_suppkey % 7 = 0 THEN '5/0' ELSE CAST(10 + s_suppkey % 90 AS STRING) || '/' || CAST(20 + s_suppkey % 50 AS STRING) END AS phase_2c,
 CAST(NULL AS STRING) AS phase_2c_sup FROM supplier""",
    # Untidy text forms of the sale columns, for the cleaning functions.
    "f_messy": """SELECT o_orderkey AS id,
 CASE o_orderkey % 6 WHEN 0 THEN CAST(o_totalprice AS STRING) WHEN 1 THEN ' ' || CAST(o_orderkey AS STRING) || ' '
  WHEN 2 THEN 'n/a' WHEN 3 THEN '' WHEN 4 THEN '-12.5' ELSE NULL END AS number_text,
 CASE o_orderkey % 4 WHEN 0 THEN substr(CAST(o_orderdate AS STRING),1,7) WHEN 1 THEN '1999-13'
  WHEN 2 THEN substr(CAST(o_orderdate AS STRING),1,10) ELSE NULL END AS month_text,
 CASE o_orderkey % 5 WHEN 0 THEN '10 TO 12' WHEN 1 THEN '7' WHEN 2 THEN 'GROUND' WHEN 3 THEN '1 TO 3 TO 9' ELSE NULL END AS storey_text,
 CASE o_orderkey % 6 WHEN 0 THEN ' 61 Years 04 Months ' WHEN 1 THEN '70 years' WHEN 2 THEN '9 months' WHEN 3 THEN 'freehold'
  WHEN 4 THEN '1 year 1 month' ELSE NULL END AS lease_text,
 CASE o_orderkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN ' yes ' WHEN 2 THEN '0' WHEN 3 THEN 'GOOD' WHEN 4 THEN '2' ELSE NULL END AS bool_text,
 '  ' || lower(o_orderpriority) || '   exit ' || CAST(o_orderkey % 9 AS STRING) AS station_text,
 CASE o_orderkey % 5 WHEN 0 THEN '["North South Line", " Circle Line ", ""]' WHEN 1 THEN '[''East West Line'', ''Downtown Line'']'
  WHEN 2 THEN 'Thomson Line, ,Circle Line' WHEN 3 THEN '' ELSE NULL END AS lines_text,
 CASE o_orderkey % 3 WHEN 0 THEN 'Canossa Catholic Primary School (Primary)' WHEN 1 THEN 'St. Hilda''s Primary' ELSE o_orderpriority END AS school_text
 FROM orders""",
}

# Sales with address and amenity-derived attributes, wide enough for the price models.
VIEW_SQL["f_feature"] = f"""SELECT t.*,
 CAST((a.ck * 31) % 1500 AS DOUBLE) AS nearest_mall_walking_distance_m, CAST(a.ck % 3 AS INT) AS malls_within_10min_walk,
 CAST((a.ck * 57) % 1800 AS DOUBLE) AS nearest_mrt_walking_distance_m, CAST(a.ck % 5 AS INT) AS mrt_unique_lines_within_10min_walk,
 t.school_count_1km + CAST(a.ck % 6 AS INT) AS school_count_2km, t.good_school_count_1km + CAST(a.ck % 2 AS INT) AS good_school_count_2km,
 CAST((a.ck * 13) % 400 AS DOUBLE) AS nearest_bus_stop_walking_distance_m, CAST(a.ck % 7 AS INT) AS bus_stops_within_5min_walk,
 CAST((a.ck * 71) % 2200 AS DOUBLE) AS nearest_hawker_centre_walking_distance_m, CAST(a.ck % 4 AS INT) AS hawker_centres_within_5min_walk,
 CAST((a.ck * 43) % 900 AS DOUBLE) AS nearest_supermarket_walking_distance_m, CAST(a.ck % 8 AS INT) AS supermarkets_within_10min_walk,
 CAST((a.ck * 29) % 1200 AS DOUBLE) AS nearest_park_walking_distance_m, CAST(a.ck % 9 AS INT) AS parks_within_5min_walk,
 CASE WHEN a.ck % 50 = 0 THEN NULL ELSE CAST((a.ck * 83) % 1700 AS DOUBLE) END AS nearest_pcn_walking_distance_m, CAST(a.ck % 11 AS INT) AS pcns_within_5min_walk
 FROM ({_TXN}) t JOIN ({_ADDRESS}) a ON t.address_key = a.address_key"""


class Tables:
    """The given parquet tables and the sample views over them, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = _SOURCE.sub(r"\1 {\2}", VIEW_SQL[name])
        used = {t: self.table(t) for t in set(m.group(2) for m in _SOURCE.finditer(VIEW_SQL[name]))}
        return self.spark.sql(sql, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
