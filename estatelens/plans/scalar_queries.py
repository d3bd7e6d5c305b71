"""Cleaning and deriving columns; each query projects over the whole sample table."""

from pyspark.sql import functions as F

from ..functions import geo, scalar as S
from ..operators.models import engineer_features, time_split
from .registry import query, r6

NUM = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


@query("to_numeric_coerce", f"""SELECT id, CASE WHEN regexp_matches(number_text, {NUM}) THEN
 try_cast(trim(number_text) AS DOUBLE) END AS value FROM {{f_messy}} t""")
def to_numeric_coerce(t):
    return t.f_messy.select("id", S.to_number(F.col("number_text")).alias("value"))


@query("parse_month", """SELECT id, CASE WHEN regexp_matches(month_text, '^[0-9]{4}-[0-9]{2}$')
 THEN try_cast(month_text || '-01' AS DATE) END AS month_start FROM {f_messy} t""")
def parse_month(t):
    return t.f_messy.select("id", S.parse_month(F.col("month_text")).alias("month_start"))


@query("month_parts", """SELECT txn_id, month AS month_period, CAST(substr(month,1,4) AS INTEGER) AS sale_year,
 CAST(substr(month,6,2) AS INTEGER) AS sale_month FROM {f_txn} t""")
def month_parts(t):
    m = S.parse_month(F.col("month"))
    return t.f_txn.select(
        "txn_id", S.month_text(m).alias("month_period"), F.year(m).alias("sale_year"), F.month(m).alias("sale_month")
    )


@query("months_since_start", """WITH t AS (SELECT txn_id, CAST(month || '-01' AS DATE) AS m FROM {f_txn} x)
 SELECT txn_id, CAST(date_diff('month', (SELECT min(m) FROM t), m) AS INTEGER) AS months_since_start FROM t""")
def months_since_start(t):
    sales = t.f_txn.select("txn_id", S.parse_month(F.col("month")).alias("m"))
    start = sales.select(F.min("m")).scalar()
    return sales.select("txn_id", S.months_between_starts(F.col("m"), start).alias("months_since_start"))


@query("parse_remaining_lease", r"""SELECT id, round(CASE WHEN lease_text IS NOT NULL THEN
 coalesce(try_cast(regexp_extract(lower(lease_text), '(\d+)\s+year', 1) AS INTEGER), 0)
 + coalesce(try_cast(regexp_extract(lower(lease_text), '(\d+)\s+month', 1) AS INTEGER), 0) / 12.0 END, 6) AS years FROM {f_messy} t""")
def parse_remaining_lease(t):
    return t.f_messy.select("id", r6(S.remaining_lease_years(F.col("lease_text")), "years"))


@query("parse_storey_mid", r"""SELECT id, CASE len(n) WHEN 0 THEN NULL WHEN 1 THEN CAST(n[1] AS DOUBLE)
 ELSE (CAST(n[1] AS DOUBLE) + CAST(n[2] AS DOUBLE)) / 2 END AS storey_mid
 FROM (SELECT id, regexp_extract_all(storey_text, '\d+') AS n FROM {f_messy} m) t""")
def parse_storey_mid(t):
    return t.f_messy.select("id", S.storey_mid(F.col("storey_text")).alias("storey_mid"))


@query("add_log_distance", """SELECT txn_id, round(ln(greatest(nearest_mall_walking_distance_m, 1)), 6) AS ln_mall,
 CASE WHEN nearest_pcn_walking_distance_m IS NOT NULL THEN round(ln(greatest(nearest_pcn_walking_distance_m, 1)), 6) END AS ln_pcn FROM {f_feature} t""")
def add_log_distance(t):
    return t.f_feature.select(
        "txn_id",
        r6(S.log_distance(F.col("nearest_mall_walking_distance_m")), "ln_mall"),
        r6(S.log_distance(F.col("nearest_pcn_walking_distance_m")), "ln_pcn"),
    )


@query("lease_age_years", """SELECT txn_id, CAST(CAST(substr(month,1,4) AS INTEGER) - lease_commence_date AS DOUBLE) AS lease_age_years FROM {f_txn} t""")
def lease_age_years(t):
    return t.f_txn.select(
        "txn_id",
        S.lease_age_years(S.parse_month(F.col("month")), F.col("lease_commence_date")).alias("lease_age_years"),
    )


@query("good_school_indicator", """SELECT txn_id, CAST(good_school_count_1km > 0 AS INTEGER) AS good_school_within_1km FROM {f_txn} t""")
def good_school_indicator(t):
    return t.f_txn.select(
        "txn_id", S.good_school_indicator(F.col("good_school_count_1km")).alias("good_school_within_1km")
    )


@query("log_price", """SELECT txn_id, round(ln(resale_price), 6) AS log_resale_price FROM {f_txn} t""")
def log_price(t):
    return t.f_txn.select("txn_id", r6(S.log_price(F.col("resale_price")), "log_resale_price"))


@query("address_key", """SELECT txn_id, trim(town) || '|' || trim(block) || '|' || trim(street_name) AS made_key FROM {f_txn} t""")
def address_key(t):
    return t.f_txn.select(
        "txn_id", S.address_key(F.col("town"), F.col("block"), F.col("street_name")).alias("made_key")
    )


@query("join_key", """SELECT id, regexp_replace(regexp_replace(upper(school_text), '[^A-Z0-9]', '', 'g'), 'PRIMARY$', '') AS school_key FROM {f_messy} t""")
def join_key(t):
    return t.f_messy.select("id", S.join_key(F.col("school_text")).alias("school_key"))


@query("parse_ratio", r"""SELECT school_id, CASE WHEN v > 0 THEN a END AS applicants, CASE WHEN v > 0 THEN v END AS vacancies,
 CASE WHEN v > 0 THEN round(a / v, 6) END AS ratio FROM (SELECT school_id,
 try_cast(regexp_extract(p, '^\s*(\d+)\s*/\s*(\d+)\s*$', 1) AS BIGINT) AS a,
 try_cast(regexp_extract(p, '^\s*(\d+)\s*/\s*(\d+)\s*$', 2) AS BIGINT) AS v
 FROM (SELECT school_id, phase_2b AS p FROM {f_ratio} r UNION ALL SELECT school_id, phase_2c FROM {f_ratio} r2) u) t""")
def parse_ratio(t):
    both = t.f_ratio.select("school_id", F.explode(F.array("phase_2b", "phase_2c")).alias("p"))
    r = both.select("school_id", S.parse_ratio(F.col("p")).alias("r"))
    return r.select("school_id", "r.applicants", "r.vacancies", r6("r.ratio", "ratio"))


@query("normalize_station_name", r"""SELECT id, regexp_replace(trim(upper(station_text)), '\s+', ' ', 'g') AS station,
 regexp_replace(trim(upper(station_text)), '\s+', ' ', 'g') || ' MRT STATION' AS full_name FROM {f_messy} t""")
def normalize_station_name(t):
    c = F.col("station_text")
    return t.f_messy.select(
        "id", S.station_name(c).alias("station"), S.full_station_name(c, F.lit("mrt")).alias("full_name")
    )


@query("parse_lines_value", r"""SELECT id, CAST(len(l) AS INTEGER) AS n_lines, array_to_string(l, ';') AS lines FROM (SELECT id,
 list_filter(list_transform(string_split(regexp_replace(coalesce(lines_text, ''), '[\[\]"'']', '', 'g'), ','),
 lambda x: trim(x)), lambda x: x <> '') AS l FROM {f_messy} m) t""")
def parse_lines_value(t):
    l = S.parse_lines(F.col("lines_text"))
    return t.f_messy.select("id", F.size(l).alias("n_lines"), F.array_join(l, ";").alias("lines"))


@query("normalise_bool", """SELECT id, coalesce(lower(trim(bool_text)) IN ('true','1','yes'), false) AS narrow,
 coalesce(lower(trim(bool_text)) IN ('1','true','yes','y','good') OR coalesce(try_cast(bool_text AS DOUBLE) <> 0, false), false) AS wide FROM {f_messy} t""")
def normalise_bool(t):
    c = F.col("bool_text")
    return t.f_messy.select("id", S.normalise_bool(c).alias("narrow"), S.is_true(c).alias("wide"))


@query("fill_and_cast_counts", f"""SELECT id, coalesce(CAST(trunc(CASE WHEN regexp_matches(number_text, {NUM})
 THEN try_cast(trim(number_text) AS DOUBLE) END) AS INTEGER), 0) AS n FROM {{f_messy}} t""")
def fill_and_cast_counts(t):
    return t.f_messy.select("id", S.fill_count(F.col("number_text")).alias("n"))


@query("tier_label", """SELECT school_id, CASE WHEN is_good_school THEN 'Good' ELSE 'Normal' END AS school_tier FROM {f_school} t""")
def tier_label(t):
    return t.f_school.select("school_id", S.tier_label(F.col("is_good_school")).alias("school_tier"))


def priced(t):
    """Sales with a stand-in prediction: the price per square metre of 5000."""
    return t.f_txn.withColumn("predicted_resale_price", F.col("floor_area_sqm") * 5000)


@query("price_gap", """SELECT txn_id, resale_price - p AS prediction_error, (resale_price - p) / p AS price_gap_pct,
 coalesce(resale_price, p) AS display_price, CASE WHEN resale_price IS NULL THEN 'Predicted price' ELSE 'Price' END AS display_price_type
 FROM (SELECT *, floor_area_sqm * 5000 AS p FROM {f_txn} x) t""")
def price_gap(t):
    p, a = F.col("predicted_resale_price"), F.col("resale_price")
    return priced(t).select(
        "txn_id",
        (a - p).alias("prediction_error"),
        F.try_divide(a - p, p).alias("price_gap_pct"),
        F.coalesce(a, p).alias("display_price"),
        F.when(a.isNull(), "Predicted price").otherwise("Price").alias("display_price_type"),
    )


@query("estate_default_labels", """SELECT id, coalesce(lease_text, 'Unknown') AS school_tier, coalesce(lines_text, 'None listed') AS estates FROM {f_messy} t""")
def estate_default_labels(t):
    return t.f_messy.select(
        "id",
        F.coalesce("lease_text", F.lit("Unknown")).alias("school_tier"),
        F.coalesce("lines_text", F.lit("None listed")).alias("estates"),
    )


@query("points_from_lonlat", """SELECT id, CAST(number_text AS DOUBLE) AS longitude, CAST(id AS DOUBLE) / 1000 AS latitude
 FROM (SELECT id, CASE WHEN id % 6 IN (0, 1, 4) THEN trim(number_text) END AS number_text FROM {f_messy} m) t WHERE number_text IS NOT NULL""")
def points_from_lonlat(t):
    return t.f_messy.select(
        "id", S.to_number(F.col("number_text")).alias("longitude"), (F.col("id") / 1000).alias("latitude")
    ).dropna(subset=["longitude", "latitude"])


_E2 = geo.WGS84_F * (2 - geo.WGS84_F)
# Length of the meridian from the equator, by the series in multiples of the latitude.
_ARC = (f"{geo.WGS84_A} * ((1 - {_E2} / 4 - 3 * pow({_E2}, 2) / 64 - 5 * pow({_E2}, 3) / 256) * %(b)s"
        f" - (3 * {_E2} / 8 + 3 * pow({_E2}, 2) / 32 + 45 * pow({_E2}, 3) / 1024) * sin(2 * %(b)s)"
        f" + (15 * pow({_E2}, 2) / 256 + 45 * pow({_E2}, 3) / 1024) * sin(4 * %(b)s) - 35 * pow({_E2}, 3) / 3072 * sin(6 * %(b)s))")


@query("project_svy21", f"""WITH a AS (SELECT address_key, radians(latitude) AS b, radians(longitude) - radians({geo.ORIGIN_LON}) AS l FROM {{f_address}} t),
 c AS (SELECT *, {geo.WGS84_A} / sqrt(1 - {_E2} * sin(b) * sin(b)) AS nu, (1 - {_E2} * sin(b) * sin(b)) / (1 - {_E2}) AS psi,
  tan(b) * tan(b) AS t2, l * cos(b) AS k, {_ARC % dict(b='b')} - ({_ARC % dict(b=f'radians({geo.ORIGIN_LAT})')}) AS arc FROM a)
 SELECT address_key,
 round({geo.FALSE_EASTING} + nu * k * (1 + k * k / 6 * (psi - t2) + pow(k, 4) / 120 * (4 * pow(psi, 3) * (1 - 6 * t2)
  + psi * psi * (1 + 8 * t2) - 2 * psi * t2 + t2 * t2)), 3) AS easting,
 round({geo.FALSE_NORTHING} + arc + nu * tan(b) * k * k / 2 * (1 + k * k / 12 * (4 * psi * psi + psi - t2) + pow(k, 4) / 360
  * (8 * pow(psi, 4) * (11 - 24 * t2) - 28 * pow(psi, 3) * (1 - 6 * t2) + psi * psi * (1 - 32 * t2) - 2 * psi * t2 + t2 * t2)), 3) AS northing,
 CAST(0 AS DOUBLE) AS lat_error, CAST(0 AS DOUBLE) AS lon_error FROM c""")
def project_svy21(t):
    """Degrees to plane metres and back; the result columns show the round trip."""
    a = t.f_address
    x, y = geo.to_svy21(F.col("latitude"), F.col("longitude"))
    moved = a.select("address_key", "latitude", "longitude", x.alias("easting"), y.alias("northing"))
    lat, lon = geo.from_svy21(F.col("easting"), F.col("northing"))
    return moved.select(
        "address_key", r6("easting", "easting", 3), r6("northing", "northing", 3),
        r6(lat - F.col("latitude"), "lat_error", 8), r6(lon - F.col("longitude"), "lon_error", 8),
    )


_FLAT = ("sqrt(pow((b.latitude - a.latitude) * 111.32, 2) + pow((b.longitude - a.longitude) * 111.32"
         " * cos(radians((a.latitude + b.latitude) / 2)), 2))")


@query("planar_distance_km", f"""SELECT a.address_key, round({_FLAT}, 6) AS km FROM {{f_address}} a
 JOIN {{f_amenity}} b ON b.amenity_id = a.ck % (SELECT count(*) FROM {{f_amenity}} c)""")
def planar_distance_km(t):
    a = t.f_address
    b = t.f_amenity.select("amenity_id", F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    j = a.join(b, F.col("amenity_id") == F.col("ck") % b.count())
    d = geo.flat_distance_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2"))
    return j.select("address_key", r6(d, "km"))


@query("engineer_features", """WITH t AS (SELECT *, CAST(month || '-01' AS DATE) AS m FROM {f_feature} x)
 SELECT txn_id, month AS month_period, round(ln(resale_price), 6) AS log_resale_price, floor_area_sqm,
 CAST(year(m) - lease_commence_date AS DOUBLE) AS lease_age_years,
 round(CASE WHEN remaining_lease IS NOT NULL THEN coalesce(try_cast(regexp_extract(remaining_lease, '(\\d+)\\s+year', 1) AS INTEGER), 0)
  + coalesce(try_cast(regexp_extract(remaining_lease, '(\\d+)\\s+month', 1) AS INTEGER), 0) / 12.0 END, 6) AS remaining_lease_years,
 (CAST(substr(storey_range,1,2) AS DOUBLE) + CAST(substr(storey_range,7,2) AS DOUBLE)) / 2 AS storey_mid,
 CAST(date_diff('month', (SELECT min(m) FROM t), m) AS DOUBLE) AS months_since_start,
 round(ln(greatest(nearest_mall_walking_distance_m, 1)), 6) AS ln_mall,
 CAST(good_school_count_1km > 0 AS DOUBLE) AS good_school_within_1km, town, flat_type, flat_model
 FROM t WHERE resale_price IS NOT NULL""".replace("\\\\", "\\"))
def engineer_features_query(t):
    f = engineer_features(t.f_feature, keep=["txn_id"])
    return f.select(
        "txn_id", "month_period", r6("log_resale_price", "log_resale_price"), "floor_area_sqm", "lease_age_years",
        r6("remaining_lease_years", "remaining_lease_years"), "storey_mid", "months_since_start",
        r6("ln_nearest_mall_walking_distance_m", "ln_mall"), "good_school_within_1km", "town", "flat_type", "flat_model",
    )


@query("time_split", """WITH t AS (SELECT txn_id, CAST(month || '-01' AS DATE) AS m FROM {f_feature} x WHERE resale_price IS NOT NULL)
 SELECT txn_id, CASE WHEN m >= (SELECT max(m) FROM t) - INTERVAL 11 MONTH THEN 'test' ELSE 'train' END AS dataset_split FROM t""")
def time_split_query(t):
    train, test = time_split(engineer_features(t.f_feature, keep=["txn_id"]), 12)
    return train.select("txn_id", S.split_label(F.lit(False)).alias("dataset_split")).unionByName(
        test.select("txn_id", S.split_label(F.lit(True)).alias("dataset_split"))
    )


@query("coef_to_premium", """SELECT txn_id, round(exp(c) - 1, 6) AS premium_pct, round(exp(c - 1.96 * se) - 1, 6) AS ci_low_pct,
 round(exp(c + 1.96 * se) - 1, 6) AS ci_high_pct FROM (SELECT txn_id, good_school_count_1km / 20.0 AS c, floor_area_sqm / 5000 AS se FROM {f_txn} x) t""")
def coef_to_premium(t):
    c, se = F.col("good_school_count_1km") / 20, F.col("floor_area_sqm") / 5000
    return t.f_txn.select(
        "txn_id", r6(S.premium_pct(c), "premium_pct"), r6(S.premium_pct(c - 1.96 * se), "ci_low_pct"),
        r6(S.premium_pct(c + 1.96 * se), "ci_high_pct"),
    )


@query("triangular_weights", """SELECT txn_id, round(greatest(0, 1 - abs(floor_area_sqm - 90) / 50), 6) AS kernel_weight FROM {f_txn} t""")
def triangular_weights(t):
    return t.f_txn.select(
        "txn_id", r6(S.triangular_weight(F.col("floor_area_sqm") - 90, F.lit(50.0)), "kernel_weight")
    )


@query("rdd_features", """SELECT txn_id, address_key, month AS month_period, town, round(ln(resale_price), 6) AS log_resale_price, floor_area_sqm,
 CAST(CAST(substr(month,1,4) AS INTEGER) - lease_commence_date AS DOUBLE) AS lease_age_years FROM {f_txn} t WHERE resale_price IS NOT NULL""")
def rdd_features_query(t):
    from ..operators.rdd import rdd_features

    f = rdd_features(t.f_txn, keep=["txn_id"])
    return f.select(
        "txn_id", "address_key", "month_period", "town", r6("log_resale_price", "log_resale_price"),
        "floor_area_sqm", "lease_age_years",
    )
