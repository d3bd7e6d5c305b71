"""File formats: sample layers written by Spark and read back, and values taken from HTML."""

from pyspark.sql import functions as F

from ..scratch import scratch_dir
from ..sources import files, html
from .registry import query

_SALE = "txn_id, month, town, flat_type, storey_range, floor_area_sqm, lease_commence_date, remaining_lease, resale_price"
SALE = _SALE.split(", ")
SALE_SCHEMA = (
    "txn_id long, month string, town string, flat_type string, storey_range string, floor_area_sqm double, "
    "lease_commence_date int, remaining_lease string, resale_price double"
)


def sale_csv(t):
    path = scratch_dir(t.spark)
    files.write_csv(t.f_txn.select(*SALE), path)
    return path


@query("csv_scan", f"SELECT {_SALE} FROM {{f_txn}} t")
def csv_scan(t):
    return files.read_csv(t.spark, sale_csv(t), SALE_SCHEMA)


@query("csv_scan_pruned", "SELECT town, resale_price FROM {f_txn} t")
def csv_scan_pruned(t):
    return files.read_csv(t.spark, sale_csv(t), SALE_SCHEMA, ["town", "resale_price"])


@query("csv_sink", "SELECT town, count(*) AS n, max(month) AS last_month FROM {f_txn} t GROUP BY town")
def csv_sink(t):
    path = scratch_dir(t.spark)
    files.write_csv(t.f_txn.groupBy("town").agg(F.count("*").alias("n"), F.max("month").alias("last_month")), path)
    return files.read_csv(t.spark, path, "town string, n long, last_month string")


def building_rings(t):
    """Buildings with their ring as nested coordinate lists."""
    b = t.f_building
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    ring = F.array(*[F.array(F.col("cx") + dx * F.col("h"), F.col("cy") + dy * F.col("h")) for dx, dy in corners])
    return b.withColumn("coordinates", F.array(ring))


@query("geojson_features", """SELECT building_id, block_no, postal_code, CAST(seq AS INTEGER) AS seq, x1, y1, x2, y2 FROM {f_building_edge} t""")
def geojson_features(t):
    path = scratch_dir(t.spark)
    files.write_geojson(building_rings(t), path, ["building_id", "block_no", "postal_code"], "Polygon", "coordinates")
    rows = files.read_geojson(
        t.spark, path, "struct<building_id: long, block_no: string, postal_code: string>", "Polygon", one_per_line=True
    )
    return files.polygon_edges(rows, ["building_id", "block_no", "postal_code"]).drop("ring")


@query("geojson_sink", """SELECT amenity_id, lines_present_json AS lines_text, x, y FROM {f_amenity} t""")
def geojson_sink(t):
    path = scratch_dir(t.spark)
    a = t.f_amenity.select(
        "amenity_id", F.from_json("lines_present_json", "array<string>").alias("lines_present"), F.array("x", "y").alias("coordinates")
    )
    files.write_geojson(a, path, ["amenity_id", "lines_present"], "Point", "coordinates")
    rows = files.read_geojson(t.spark, path, "struct<amenity_id: long, lines_present: string>", "Point", one_per_line=True)
    x, y = files.point_coordinates()
    return rows.select("amenity_id", F.col("lines_present").alias("lines_text"), x.alias("x"), y.alias("y"))


@query("json_artifact_scan", """SELECT count(*) AS rows_total, count(DISTINCT town) AS towns, max(month) AS last_month FROM {f_txn} t""")
def json_artifact_scan(t):
    path = scratch_dir(t.spark)
    facts = t.f_txn.agg(F.count("*").alias("rows_total"), F.countDistinct("town").alias("towns"), F.max("month").alias("last_month"))
    files.write_json_records(facts, path)
    return files.read_json(t.spark, path, "rows_total long, towns long, last_month string")


@query("json_records_sink", "SELECT town, flat_type, count(*) AS n FROM {f_txn} t GROUP BY 1, 2")
def json_records_sink(t):
    path = scratch_dir(t.spark)
    files.write_json_records(t.f_txn.groupBy("town", "flat_type").agg(F.count("*").alias("n")), path)
    return files.read_json(t.spark, path, "town string, flat_type string, n long", multiline=False)


def _info(label, value):
    return f"""'<span class="info-title">{label}</span> <span class="x info-data">' || {value} || '</span>'"""


# Ballot cards built from the sample ratios: one card per school.
_PHASE = '<div class="moe-vacancies-ballot-card__phase">'
CARD_SQL = f"""SELECT school_id, '<div class="card"><h3>' || name || '</h3><div class="moe-vacancies-ballot-card__total-vacancies"><b>Total</b><p> ' || CAST(school_id % 90 AS STRING) || ' </p></div>'
 || '{_PHASE}<p class="moe-vacancies-ballot-card--dot-active-in-phase-green">VacanciesBallot_triangle__3pm5V</p></div>'
 || '{_PHASE}<h4 class="dot moe-vacancies-ballot-card--dot-active-in-phase-green">2A</h4>' || {_info("Applicants", "CAST(20 + school_id % 60 AS STRING)")} || {_info("Vacancies", "CAST(30 + school_id % 40 AS STRING)")}
 || '<div class="moe-vacancies-ballot-card__balloting"><span>No</span></div></div>'
 || '{_PHASE}<h4 class="moe-vacancies-ballot-card--dot-active-in-phase-red">2B</h4>' || {_info("Applicants", "CAST(school_id % 25 AS STRING)")} || {_info("Vacancies", "CAST(20 + school_id % 20 AS STRING)")}
 || '<div class="moe-vacancies-ballot-card__balloting"><span>Yes</span></div><div class="info-block-balloted">' || {_info("Balloting applicants", "CAST(school_id % 25 AS STRING)")} || {_info("Vacancies for ballot", "CAST(school_id % 20 AS STRING)")} || '</div></div>'
 || CASE WHEN school_id % 3 = 0 THEN '' ELSE '{_PHASE}<h4 class="VacanciesBallot_triangle__3pm5V">2C</h4></div>' END || '</div>' AS html FROM """


@query("html_label_value", """SELECT school_id, name, CAST(school_id % 90 AS VARCHAR) AS vacancies, 'No registration was conducted' AS phase_1,
 'All applicants were successful' AS phase_2a, CAST(20 + school_id % 60 AS VARCHAR) || '/' || CAST(30 + school_id % 40 AS VARCHAR) AS phase_2a_ratio, 'No' AS phase_2a_balloting, 'N/A' AS phase_2a_balloting_ratio,
 'There were more applicants than vacancies' AS phase_2b, CAST(school_id % 25 AS VARCHAR) || '/' || CAST(20 + school_id % 20 AS VARCHAR) AS phase_2b_ratio, 'Yes' AS phase_2b_balloting,
 CAST(school_id % 25 AS VARCHAR) || '/' || CAST(school_id % 20 AS VARCHAR) AS phase_2b_balloting_ratio,
 CASE WHEN school_id % 3 = 0 THEN 'N/A' ELSE 'No registration was conducted' END AS phase_2c, 'N/A' AS phase_2c_ratio, 'N/A' AS phase_2c_balloting, 'N/A' AS phase_2c_balloting_ratio,
 'N/A' AS phase_2c_sup, 'N/A' AS phase_2c_sup_ratio, 'N/A' AS phase_2c_sup_balloting, 'N/A' AS phase_2c_sup_balloting_ratio FROM {f_ratio} t""")
def html_label_value(t):
    cards = t.spark.sql(CARD_SQL + "{r}", r=t.f_ratio)
    return html.ballot_cards(cards, "school_id", "html")


@query("html_page_fields", r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<h1[ >].*?</h1>', 0), '<[^>]*>', '', 'g')) AS heading,
 CAST(len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '(?s)<p[ >].*?</p>', 0)) AS INTEGER) AS n_paragraphs FROM pages""")
def html_page_fields(t):
    c = F.col("html")
    return t.pages.select(
        "page_id",
        F.coalesce(F.get(html.tag_texts(c, "h1"), F.lit(0)), F.lit("")).alias("heading"),
        F.size(html.attribute_values(c, "a", "href")).alias("n_links"),
        F.size(html.tag_texts(c, "p")).alias("n_paragraphs"),
    )


@query("html_description_field", """SELECT amenity_id, amenity_name AS lic_name, CASE WHEN amenity_id % 4 = 0 THEN NULL ELSE 'BLK/' || CAST(amenity_id AS VARCHAR) END AS blk_house,
 CAST(NULL AS VARCHAR) AS street FROM {f_amenity} t""")
def html_description_field(t):
    house = F.when(F.col("amenity_id") % 4 == 0, " <i></i> ").otherwise(F.concat(F.lit("BLK\\/"), F.col("amenity_id").cast("string")))
    text = F.concat(
        F.lit("<table><tr><th>LIC_NAME</th> <td><b>"), "amenity_name", F.lit("</b></td></tr><tr><th>BLK_HOUSE</th>\n<td>"), house, F.lit("</td></tr></table>")
    )
    d = t.f_amenity.select("amenity_id", text.alias("d"))
    return d.select(
        "amenity_id", html.description_field(F.col("d"), "LIC_NAME").alias("lic_name"),
        html.description_field(F.col("d"), "BLK_HOUSE").alias("blk_house"), html.description_field(F.col("d"), "STR_NAME").alias("street"),
    )
