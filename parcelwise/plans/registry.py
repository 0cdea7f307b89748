"""All registered queries over the driver's tables, and DuckDB SQL that says the same.

The tables have no buildings, so each query applies an operator's rule to columns that stand for its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions.geometry import affine, area, common_area, intersection_area, is_simple, perimeter, rectangle, repaired, total_area
from parcelwise.functions.names import AUTHORITY_IDS, NO_AUTHORITY_ID, building_id, view_of
from parcelwise.functions.records import nested_get
from parcelwise.functions.rounding import py_round, py_round_sql
from parcelwise.operators import footprints, inventory, matching, pairs, positions, properties, units
from parcelwise.sources.files import authority_ids, building_folders

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprints.city_grid(read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("n"))).withColumn("ord", F.col("n"))


_GRID = """g0 AS (SELECT p_partkey + 1 AS n, p_partkey AS i FROM part),
g AS (SELECT n, printf('B%03d', n) AS building_id, (8 + (3 * n) % 9)::INTEGER AS w, (7 + (5 * n) % 8)::INTEGER AS d, (2 + (7 * n) % 6)::INTEGER AS floors,
  (18 + 22 * (i % 5))::INTEGER AS x, (18 + 20 * (i // 5))::INTEGER AS z, i,
  CASE i % 5 WHEN 2 THEN 'commercial' WHEN 4 THEN 'institutional' ELSE 'residential' END AS type, n % 5 = 0 AS "hasBasement" FROM g0)"""


@query(f'WITH {_GRID} SELECT building_id, x, z, w, d, floors, 3.0::DOUBLE * floors AS h, (w * d)::DOUBLE AS area_pixels, type, "hasBasement" FROM g')
def city_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("building_id", "x", "z", "w", "d", "floors", "h", "area_pixels", "type", "hasBasement")


def _parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels on the customers' grid places: some shifted, some wider, some missing, so that all statuses occur."""
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("n"), F.pmod("c_custkey", F.lit(5)).alias("v")).where("v != 3")
    g = footprints.city_grid(c).join(c, "n")
    shift = F.when(F.col("v") == 1, 0.5 * F.col("w")).when(F.col("v") == 2, 0.95 * F.col("w")).otherwise(0.0)
    more = F.when(F.col("v") == 0, 0.5).when(F.col("v") == 4, 6.0).otherwise(0.0)
    box = rectangle(F.col("x") + shift - F.col("w") / 2 - more, F.col("z") - F.col("d") / 2 - more, F.col("x") + shift + F.col("w") / 2 + more, F.col("z") + F.col("d") / 2 + more)
    return g.select(F.format_string("P%03d", "n").alias("parcel_id"), F.col("n").alias("ord"), box.alias("polygon"))


_MATCHED = f"""{_GRID},
c0 AS (SELECT c_custkey + 1 AS n, c_custkey AS i, c_custkey % 5 AS v FROM customer WHERE c_custkey % 5 <> 3),
c1 AS (SELECT n, v, 8 + (3 * n) % 9 AS w, 7 + (5 * n) % 8 AS d, 18 + 22 * (i % 5) AS x, 18 + 20 * (i // 5) AS z,
  CASE v WHEN 0 THEN 0.5::DOUBLE WHEN 4 THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END AS more FROM c0),
c2 AS (SELECT *, CASE v WHEN 1 THEN 0.5::DOUBLE * w WHEN 2 THEN 0.95::DOUBLE * w ELSE 0.0::DOUBLE END AS shift FROM c1),
p AS (SELECT n AS pn, printf('P%03d', n) AS parcel_id, x + shift - w / 2.0::DOUBLE - more AS px1, z - d / 2.0::DOUBLE - more AS py1,
  x + shift + w / 2.0::DOUBLE + more AS px2, z + d / 2.0::DOUBLE + more AS py2 FROM c2),
b AS (SELECT n, building_id, (w * d)::DOUBLE AS own, x - w / 2.0::DOUBLE AS x1, z - d / 2.0::DOUBLE AS y1, x + w / 2.0::DOUBLE AS x2, z + d / 2.0::DOUBLE AS y2 FROM g),
o AS (SELECT n, pn, parcel_id, own, (px2 - px1) * (py2 - py1) AS other, (least(x2, px2) - greatest(x1, px1)) * (least(y2, py2) - greatest(y1, py1)) AS common
  FROM b JOIN p ON x1 < px2 AND px1 < x2 AND y1 < py2 AND py1 < y2),
r AS (SELECT n, parcel_id, common / (own + other - common) AS iou, common / own AS cov, row_number() OVER (PARTITION BY n ORDER BY common / (own + other - common) DESC, pn) AS k FROM o),
s AS (SELECT building_id, parcel_id, coalesce(iou, 0.0::DOUBLE) AS iou, coalesce(cov, 0.0::DOUBLE) AS cov FROM b LEFT JOIN (SELECT * FROM r WHERE k = 1) q ON b.n = q.n),
m AS (SELECT building_id, CASE WHEN parcel_id IS NULL THEN 'UNREGISTERED' WHEN cov < 0.1 THEN 'OUTSIDE_PARCEL' WHEN iou >= 0.7 THEN 'MATCH' ELSE 'PARTIAL_MATCH' END AS validation_status,
  parcel_id, {py_round_sql("iou", 4)} AS overlap_iou, {py_round_sql("cov", 4)} AS building_coverage FROM s)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_parcels(_grid(spark, sf_dir), _parcels(spark, sf_dir))


@query(f"WITH {_MATCHED} SELECT * FROM m")
def parcel_match(spark, sf_dir):
    return _matched(spark, sf_dir).drop("ord")


@query(f"WITH {_MATCHED} SELECT validation_status, count(*) AS buildings, max(overlap_iou) AS best_iou FROM m GROUP BY 1")
def match_status_counts(spark, sf_dir):
    return _matched(spark, sf_dir).groupBy("validation_status").agg(F.count(F.lit(1)).alias("buildings"), F.max("overlap_iou").alias("best_iou"))


@query(f"""WITH {_MATCHED}, a(parcel_id, official_id) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in AUTHORITY_IDS.items())})
SELECT building_id, coalesce(official_id, '{NO_AUTHORITY_ID}') AS official_ulpin, coalesce(official_id, '{NO_AUTHORITY_ID}') || '-' || building_id AS building_property_id FROM m LEFT JOIN a ON m.parcel_id = a.parcel_id""")
def authority_lookup(spark, sf_dir):
    return matching.with_authority(_matched(spark, sf_dir), authority_ids(spark, AUTHORITY_IDS)).select("building_id", "official_ulpin", "building_property_id")


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of 0 to 3,500 in half pixels, over both bounds of heights."""
    p = read(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") + 1).alias("n"), building_id(F.col("p_partkey") + 1).alias("building_id"), (0.5 * F.pmod(F.col("p_partkey") * 7, F.lit(7000))).alias("area_pixels"))


_HEIGHTS = f"""a AS (SELECT p_partkey + 1 AS n, printf('B%03d', p_partkey + 1) AS building_id, 0.5::DOUBLE * ((p_partkey * 7) % 7000) AS area_pixels FROM part),
h0 AS (SELECT *, greatest(6.0::DOUBLE, least(30.0::DOUBLE, area_pixels / 100.0::DOUBLE)) AS raw FROM a),
h1 AS (SELECT *, {py_round_sql("raw", 2)} AS height_meters FROM h0),
h AS (SELECT *, greatest(round_even(height_meters / 3.0::DOUBLE, 0)::INTEGER, 1) AS floors, CASE WHEN area_pixels <= 0 THEN 1 ELSE greatest(1, least(10, round_even(area_pixels / 70.0::DOUBLE, 0)::INTEGER)) END::INTEGER AS flats FROM h1)"""


def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _areas(spark, sf_dir).withColumn("height_meters", units.height_of_area(F.col("area_pixels")))
    return a.withColumn("floors", units.floors_of_height(F.col("height_meters"))).withColumn("flats", units.flats_per_floor(F.col("area_pixels")))


@query(f"WITH {_HEIGHTS} SELECT building_id, area_pixels, height_meters, floors FROM h")
def height_floors(spark, sf_dir):
    return _heights(spark, sf_dir).select("building_id", "area_pixels", "height_meters", "floors")


@query(f"WITH {_HEIGHTS} SELECT building_id, area_pixels, flats FROM h")
def flats_per_floor(spark, sf_dir):
    return _heights(spark, sf_dir).select("building_id", "area_pixels", "flats")


_UNITS = f"""{_HEIGHTS}, f AS (SELECT building_id, flats, unnest(range(floors))::INTEGER AS floor_number FROM h),
u0 AS (SELECT building_id, floor_number, unnest(range(1, flats + 1))::INTEGER AS k FROM f),
u AS (SELECT building_id, floor_number, printf('F%02d', floor_number) AS floor_id, CASE WHEN floor_number = 0 THEN printf('G%02d', k) ELSE printf('%d%02d', floor_number, k) END AS flat FROM u0)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.unit_rows(_heights(spark, sf_dir), F.lit(NO_AUTHORITY_ID))


@query(f"WITH {_UNITS} SELECT *, '{NO_AUTHORITY_ID}-' || building_id || '-' || floor_id || '-U' || flat AS unit_id FROM u")
def unit_ids(spark, sf_dir):
    return _units(spark, sf_dir)


@query(f"WITH {_HEIGHTS} SELECT building_id, (floors * flats)::BIGINT AS units, floors::BIGINT AS floors FROM h")
def unit_totals(spark, sf_dir):
    return _units(spark, sf_dir).groupBy("building_id").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("floor_number").alias("floors"))


@query(f"""WITH e AS (SELECT l_suppkey AS building_id, median(greatest(l_quantity - 10.0::DOUBLE * l_linenumber, 0.0::DOUBLE)) AS median_height FROM lineitem GROUP BY 1),
h AS (SELECT *, {py_round_sql("median_height", 2)} AS height_meters FROM e)
SELECT *, CASE WHEN height_meters <= 0 THEN 0 ELSE greatest(round_even(height_meters / 3.0::DOUBLE, 0)::INTEGER, 1) END::INTEGER AS estimated_floors FROM h""")
def elevation_median(spark, sf_dir):
    samples = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("building_id"), F.col("l_quantity").alias("dsm"), (F.col("l_linenumber") * 10.0).alias("dem"))
    return units.analyse_elevation(samples)


_ORIGIN = (79.1, 12.9, 0.00001, -0.00001)


@query(f"""WITH {_GRID}, v AS (SELECT building_id, unnest([0, 1, 2, 3])::INTEGER AS vertex, x - w / 2.0::DOUBLE AS x1, x + w / 2.0::DOUBLE AS x2, z - d / 2.0::DOUBLE AS y1, z + d / 2.0::DOUBLE AS y2 FROM g)
SELECT building_id, vertex, {_ORIGIN[0]}::DOUBLE + (CASE WHEN vertex IN (0, 3) THEN x1 ELSE x2 END) * {_ORIGIN[2]!r}::DOUBLE AS longitude,
  {_ORIGIN[1]}::DOUBLE + (CASE WHEN vertex IN (0, 1) THEN y1 ELSE y2 END) * ({_ORIGIN[3]!r}::DOUBLE) AS latitude FROM v""")
def affine_vertices(spark, sf_dir):
    ring = affine(F.col("polygon"), *_ORIGIN)
    return _grid(spark, sf_dir).select("building_id", F.posexplode(ring).alias("vertex", "p")).select("building_id", "vertex", F.col("p")[0].alias("longitude"), F.col("p")[1].alias("latitude"))


_SCENE_RAW = "(x - 64.0::DOUBLE) * 0.35::DOUBLE AS x0, (z - 64.0::DOUBLE) * 0.35::DOUBLE AS z0, greatest(w * 0.35::DOUBLE, 2.0::DOUBLE) AS w0, greatest(d * 0.35::DOUBLE, 2.0::DOUBLE) AS d0"


@query(f"""WITH {_GRID}, r AS (SELECT i::INTEGER AS id, building_id, {_SCENE_RAW}, greatest(6.0::DOUBLE, least(30.0::DOUBLE, (w * d) / 100.0::DOUBLE)) AS h0 FROM g), q AS (SELECT *, {py_round_sql("h0", 2)} AS h FROM r)
SELECT id, building_id, {py_round_sql("x0", 3)} AS x, {py_round_sql("z0", 3)} AS z, {py_round_sql("w0", 3)} AS w, {py_round_sql("d0", 3)} AS d, h, greatest(round_even(h / 3.0::DOUBLE, 0)::INTEGER, 1) AS floors,
  CASE id % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' ELSE 'institutional' END AS type FROM q""")
def bbox_scene(spark, sf_dir):
    placed = positions.with_position(properties.build_properties(_grid(spark, sf_dir)), F.col("ord"), [F.col("building_id")])
    n = properties.scene_numbers(F.col("geometry.polygon"), F.col("measurements.height_meters"), F.col("measurements.estimated_floors"), F.col("position"))
    return placed.select(F.col("position").cast("int").alias("id"), "building_id", *[c.alias(k) for k, c in n.items()])


@query("""SELECT CASE WHEN lower(url) LIKE '%front%' THEN 'front' WHEN lower(url) LIKE '%left%' THEN 'left' WHEN lower(url) LIKE '%right%' THEN 'right'
  WHEN lower(url) LIKE '%low%' THEN 'low' WHEN lower(url) LIKE '%zoom%' THEN 'zoom' ELSE 'unknown' END AS view_type, count(*) AS images
FROM (SELECT CASE page_id % 7 WHEN 0 THEN url || 'Front' WHEN 1 THEN url || 'yellow' WHEN 2 THEN url || 'zoomRight' WHEN 3 THEN url || 'left_low' WHEN 4 THEN url || 'ZOOM' ELSE url END AS url FROM pages) GROUP BY 1""")
def view_histogram(spark, sf_dir):
    p, k = read(spark, sf_dir, "pages"), F.pmod("page_id", F.lit(7))
    end = F.when(k == 0, "Front").when(k == 1, "yellow").when(k == 2, "zoomRight").when(k == 3, "left_low").when(k == 4, "ZOOM").otherwise("")
    return inventory.view_counts(p.select(view_of(F.concat("url", end)).alias("view_type")))


@query(f"""WITH s AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS building_id, strlen(html) / 1048576.0::DOUBLE AS mb FROM pages),
r AS (SELECT building_id, {py_round_sql("mb", 3)} AS size_mb FROM s)
SELECT building_id, count(*) AS image_count, min(size_mb) AS least_mb, max(size_mb) AS most_mb FROM r GROUP BY 1""")
def inventory_sizes(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("building_id"), (F.octet_length("html") / F.lit(1048576.0)).alias("mb"))
    return p.withColumn("size_mb", py_round(F.col("mb"), 3)).groupBy("building_id").agg(F.count(F.lit(1)).alias("image_count"), F.min("size_mb").alias("least_mb"), F.max("size_mb").alias("most_mb"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def paired_semi(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def staging_anti(spark, sf_dir):
    return inventory.to_stage(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT source AS building_id, count(*)::INTEGER AS source_images, count(*)::INTEGER AS prepared_images, 'staged/' || source || '/images' AS image_directory FROM documents GROUP BY source""")
def staging_report(spark, sf_dir):
    return inventory.staging_report(read(spark, sf_dir, "documents").select(F.col("source").alias("building_id")), "staged")


@query("""WITH r AS (SELECT c_custkey % 7 AS key, c_mktsegment AS status, c_custkey AS ord FROM customer),
f AS (SELECT key, status, row_number() OVER (PARTITION BY key ORDER BY ord) AS k FROM r)
SELECT s_suppkey AS key, coalesce(status, 'NOT_VALIDATED') AS status FROM supplier LEFT JOIN (SELECT * FROM f WHERE k = 1) q ON s_suppkey = q.key""")
def validation_merge(spark, sf_dir):
    right = read(spark, sf_dir, "customer").select(F.pmod("c_custkey", F.lit(7)).alias("key"), F.col("c_mktsegment").alias("status"), F.col("c_custkey").alias("ord"))
    return matching.merge_first(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), right, "key", "ord", {"status": F.lit("NOT_VALIDATED")})


@query("SELECT a.label AS image_a, b.label AS image_b FROM (SELECT DISTINCT label FROM embeddings) a JOIN (SELECT DISTINCT label FROM embeddings) b ON a.label < b.label")
def image_pairs(spark, sf_dir):
    return pairs.image_pairs(read(spark, sf_dir, "embeddings"), "label")


_MATCHES = """e AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.label AS image_a, b.label AS image_b, a.vec_id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM e a JOIN e b ON a.label < b.label),
k AS (SELECT image_a, image_b, vec_id, d, row_number() OVER (PARTITION BY image_a, image_b, vec_id ORDER BY d) AS r FROM d),
t AS (SELECT image_a, image_b, vec_id, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM k WHERE r <= 2 GROUP BY 1, 2, 3),
m AS (SELECT image_a, image_b, count(*)::INTEGER AS keypoints_a, (count(*) FILTER (d2 IS NOT NULL AND d1 < 0.9::DOUBLE * d2))::INTEGER AS good_matches FROM t GROUP BY 1, 2)"""


def _ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return pairs.ratio_matches(pairs.image_pairs(e, "label"), e.select(F.col("label").alias("image"), F.col("vec_id").alias("kp_idx"), F.col("embedding").alias("descriptor")), 0.9)


@query(f"WITH {_MATCHES} SELECT * FROM m")
def ratio_matches(spark, sf_dir):
    return _ratio(spark, sf_dir)


@query(f"WITH {_MATCHES} SELECT * FROM m ORDER BY good_matches DESC, image_a, image_b LIMIT 15")
def top_pairs(spark, sf_dir):
    return pairs.top_pairs(_ratio(spark, sf_dir), "good_matches", 15)


@query(f"""WITH p AS (SELECT l_suppkey AS image_a, l_linenumber AS image_b, count(*)::INTEGER AS raw_matches, (count(*) FILTER (l_discount > 0.03))::INTEGER AS f0, (count(*) FILTER (l_tax > 0.03))::INTEGER AS h0 FROM lineitem GROUP BY 1, 2),
q AS (SELECT image_a, image_b, raw_matches, (CASE WHEN raw_matches < 8 THEN 0 ELSE f0 END)::INTEGER AS fundamental_inliers, (CASE WHEN raw_matches < 8 THEN 0 ELSE h0 END)::INTEGER AS homography_inliers FROM p),
r AS (SELECT *, fundamental_inliers::DOUBLE / raw_matches AS fr, homography_inliers::DOUBLE / raw_matches AS hr FROM q)
SELECT image_a, image_b, raw_matches, fundamental_inliers, {py_round_sql("fr", 3)} AS fundamental_ratio, homography_inliers, {py_round_sql("hr", 3)} AS homography_ratio FROM r""")
def inlier_ratio(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_a"), F.col("l_linenumber").alias("image_b"))
    counts = li.agg(F.count(F.lit(1)).cast("int").alias("raw_matches"), F.count_if(F.col("l_discount") > 0.03).alias("fundamental_inliers"), F.count_if(F.col("l_tax") > 0.03).alias("homography_inliers"))
    return pairs.gated(counts).select("image_a", "image_b", "raw_matches", "fundamental_inliers", "fundamental_ratio", "homography_inliers", "homography_ratio")


@query("""WITH s AS (SELECT p_partkey, row_number() OVER (ORDER BY (p_partkey * 2654435761 + 42) % 4294967296, p_partkey) - 1 AS position FROM part)
SELECT p_partkey, position, position < (SELECT floor(count(*) * 0.8::DOUBLE) FROM part) AS is_train FROM s""")
def train_split(spark, sf_dir):
    return positions.train_split(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "v"))
    return e.select("vec_id", "idx", ((F.col("v").cast("double") + 1.0) * 127.5).alias("value"))


_PIXELS = "p AS (SELECT vec_id, (i - 1)::INTEGER AS idx, (embedding[i]::DOUBLE + 1.0::DOUBLE) * 127.5::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


@query(f"WITH {_PIXELS} SELECT vec_id, idx, (CASE WHEN value > 127 THEN 255 ELSE 0 END)::INTEGER AS mask, value / 255.0::DOUBLE AS normalized FROM p")
def pixel_binarize(spark, sf_dir):
    return _pixels(spark, sf_dir).select("vec_id", "idx", footprints.binarize(F.col("value")).alias("mask"), footprints.normalized(F.col("value")).alias("normalized"))


@query(f"WITH {_PIXELS} SELECT vec_id, count(*) FILTER (value > 127) AS building_pixels FROM p GROUP BY 1")
def pixel_sum(spark, sf_dir):
    return _pixels(spark, sf_dir).groupBy("vec_id").agg(F.sum((footprints.binarize(F.col("value")) / 255).cast("long")).alias("building_pixels"))


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of 10 x 10 pixels by arithmetic on keys."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.floor(k / 100).alias("image_id"), F.floor(F.pmod(k, F.lit(100)) / 10).cast("int").alias("y"), F.pmod(k, F.lit(10)).cast("int").alias("x"), F.when(F.pmod(k * k * 31 + k * 7, F.lit(101)) < 36, 255).otherwise(0).alias("value"))


@query("""WITH RECURSIVE m AS (SELECT p_partkey // 100 AS image_id, (p_partkey % 100) // 10 AS y, p_partkey % 10 AS x FROM part WHERE (p_partkey * p_partkey * 31 + p_partkey * 7) % 101 < 36),
t(image_id, y, x, y0, x0) AS (SELECT image_id, y, x, y, x FROM m UNION SELECT m.image_id, m.y, m.x, t.y0, t.x0 FROM t JOIN m ON m.image_id = t.image_id AND abs(m.y - t.y) <= 1 AND abs(m.x - t.x) <= 1),
c AS (SELECT image_id, y, x, min(y0 * 100 + x0) AS least FROM t GROUP BY 1, 2, 3)
SELECT image_id, (least // 100)::BIGINT * 4294967296 + least % 100 AS component, count(*) AS pixels FROM c GROUP BY image_id, least""")
def run_components(spark, sf_dir):
    labelled = footprints.components(footprints.mask_runs(_mask(spark, sf_dir)))
    return labelled.groupBy("image_id", "component").agg(F.sum(F.col("x2") - F.col("x1") + 1).cast("long").alias("pixels"))


@query("SELECT DISTINCT p_brand AS name, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS number FROM part WHERE regexp_matches(lower(p_brand), '^brand#\\d+') ORDER BY number, name LIMIT 20")
def folder_topk(spark, sf_dir):
    return building_folders(read(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct(), prefix="brand#")


@query(f"""WITH {_GRID}, q AS (SELECT building_id, (2 * w * w)::DOUBLE AS area, 4.0::DOUBLE * sqrt(2.0::DOUBLE * w * w) AS p, 7.0::DOUBLE * w * w / 6.0::DOUBLE AS c FROM g)
SELECT building_id, area, {py_round_sql("p", 4)} AS perimeter, true AS simple, {py_round_sql("c", 4)} AS common FROM q""")
def polygon_clip(spark, sf_dir):
    """Turned squares of half a diagonal w against parcels with a notch: 7/6 w w in common."""
    g = _grid(spark, sf_dir)
    x, z, w = F.col("x").cast("double"), F.col("z").cast("double"), F.col("w").cast("double")
    at = lambda a, b: F.array(x + a * w, z + b * w)
    g = g.select("building_id", F.array(at(0, -1), at(1, 0), at(0, 1), at(-1, 0)).alias("one"), F.array(at(-1, -1), at(0.5, -1), at(0.5, 0.5), at(0, 0), at(-1, 0.5)).alias("other"))
    common = F.inline(F.array(F.struct(intersection_area(F.col("one"), F.col("other")).alias("common"), perimeter(F.col("one")).alias("round"))))
    g = g.select("building_id", area(F.col("one")).alias("area"), is_simple(F.col("other")).alias("simple"), common)
    return g.select("building_id", "area", py_round(F.col("round"), 4).alias("perimeter"), "simple", py_round(F.col("common"), 4).alias("common"))


@query()
def ransac(spark, sf_dir):
    """Points of two views by arithmetic, some of them wrong."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    xa, ya = F.pmod(F.col("l_partkey") * 37, F.lit(640)).cast("double"), F.pmod(F.col("l_partkey") * 91 + F.col("q"), F.lit(480)).cast("double")
    wrong = F.pmod("l_partkey", F.lit(4)) == 0
    points = li.select(F.col("l_suppkey").alias("image_a"), (F.col("l_suppkey") + 1).alias("image_b"), xa.alias("xa"), ya.alias("ya"), F.when(wrong, ya).otherwise(0.9 * xa - 0.1 * ya + 12).alias("xb"), F.when(wrong, xa).otherwise(0.1 * xa + 0.9 * ya - 5).alias("yb"))
    return pairs.verify_geometry(points)


@query(f"WITH {_HEIGHTS} SELECT count(*) AS buildings, sum(floors)::BIGINT AS floors, sum(floors * flats)::BIGINT AS units FROM h")
def unit_grand_totals(spark, sf_dir):
    return units.grand_totals(_heights(spark, sf_dir))


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = properties.build_properties(_grid(spark, sf_dir))
    return properties.add_identifiers(properties.merge_validation(built, _matched(spark, sf_dir)), authority_ids(spark, AUTHORITY_IDS))


_IDENTIFIED = f"""{_MATCHED}, a(parcel_id, official_id) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in AUTHORITY_IDS.items())}),
h0 AS (SELECT building_id, (w * d)::DOUBLE AS area, greatest(6.0::DOUBLE, least(30.0::DOUBLE, (w * d) / 100.0::DOUBLE)) AS raw FROM g),
h AS (SELECT building_id, area, {py_round_sql("raw", 2)} AS height, greatest(1, least(10, round_even(area / 70.0::DOUBLE, 0)::INTEGER))::INTEGER AS flats FROM h0),
i AS (SELECT h.building_id, area, height, greatest(round_even(height / 3.0::DOUBLE, 0)::INTEGER, 1)::INTEGER AS floors, flats, m.parcel_id, m.validation_status, coalesce(official_id, '{NO_AUTHORITY_ID}') AS official_ulpin
  FROM h JOIN m ON h.building_id = m.building_id LEFT JOIN a ON m.parcel_id = a.parcel_id)"""


@query(f"""WITH {_IDENTIFIED} SELECT building_id, height AS height_meters, floors AS estimated_floors, (floors * flats)::INTEGER AS total_estimated_flats, validation_status, parcel_id,
  official_ulpin, official_ulpin || '-' || building_id AS building_property_id, 'PROTOTYPE' AS identifier_status FROM i""")
def property_records(spark, sf_dir):
    r = _identified(spark, sf_dir)
    return r.select("building_id", F.col("measurements.height_meters"), F.col("measurements.estimated_floors"), F.col("apartments.total_estimated_flats"), F.col("validation.status").alias("validation_status"), "validation.parcel_id", "official_ulpin", "building_property_id", "identifier_status")


@query(f"""WITH {_IDENTIFIED}, f AS (SELECT *, unnest(range(floors))::INTEGER AS floor_number FROM i)
SELECT building_id, floor_number, CASE WHEN floor_number = 0 THEN 'Ground Floor' ELSE 'Floor ' || floor_number END AS floor_label, printf('F%02d', floor_number) AS floor_id, flats AS estimated_flat_count,
  list_aggregate(list_transform(range(1, flats + 1), lambda k: official_ulpin || '-' || building_id || '-' || printf('F%02d', floor_number) || '-U' || CASE WHEN floor_number = 0 THEN printf('G%02d', k) ELSE printf('%d%02d', floor_number, k) END), 'string_agg', ' ') AS unit_ids FROM f""")
def property_floors(spark, sf_dir):
    r = _identified(spark, sf_dir).select("building_id", F.explode("apartments.floors").alias("f"))
    return r.select("building_id", "f.floor_number", "f.floor_label", "f.floor_id", "f.estimated_flat_count", F.array_join(F.col("f")["3d_property_ids"], " ").alias("unit_ids"))


@query("""WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS building_id, url FROM pages WHERE url IS NOT NULL)
SELECT building_id, count(*)::INTEGER AS image_count, string_agg(url, '|' ORDER BY url) AS images FROM p GROUP BY 1""")
def images_by_building(spark, sf_dir):
    p = read(spark, sf_dir, "pages").where("url is not null").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("building_id"), F.col("url").alias("filename"))
    found = inventory.images_by_building(p, p.select("building_id").distinct())
    return found.select("building_id", "image_count", F.array_join(F.transform("images", lambda x: x["filename"]), "|").alias("images"))


@query("""WITH m AS (SELECT p_partkey // 100 AS image_id, (p_partkey % 100) // 10 AS y, p_partkey % 10 AS x, CASE WHEN (p_partkey * p_partkey * 31 + p_partkey * 7) % 101 < 36 THEN 255 ELSE 0 END AS value FROM part),
n AS (SELECT unnest(range(25)) AS i)
SELECT image_id::VARCHAR AS path, a.i::INTEGER AS y, b.i::INTEGER AS x, 0 AS c, value FROM m JOIN n a ON a.i * 10 // 25 = m.y JOIN n b ON b.i * 10 // 25 = m.x""")
def pixel_resize(spark, sf_dir):
    m = _mask(spark, sf_dir).select(F.col("image_id").cast("string").alias("path"), "y", "x", F.lit(0).alias("c"), "value")
    return footprints.resized(m, 10, 10, 25, 25)


@query("""SELECT vec_id, (i // 12)::INTEGER AS y, (i // 3 % 4)::INTEGER AS x, (i % 3)::INTEGER AS c, (i % 3 * 12 + i // 12 * 4 + i // 3 % 4)::INTEGER AS idx, 0 AS batch
FROM (SELECT vec_id, unnest(range(36)) AS i FROM embeddings)""")
def pixel_channels(spark, sf_dir):
    i = F.col("i")
    p = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("i"))
    p = p.select("vec_id", F.floor(i / 12).cast("int").alias("y"), F.pmod(F.floor(i / 3), F.lit(4)).cast("int").alias("x"), F.pmod(i, F.lit(3)).alias("c"))
    return footprints.channel_first(p, 3, 4)


@query(f"WITH {_PIXELS} SELECT vec_id, idx, (1 / (1 + exp(-(value - 127.0::DOUBLE))) > 0.5::DOUBLE)::INTEGER AS mask FROM p")
def pixel_sigmoid(spark, sf_dir):
    return _pixels(spark, sf_dir).select("vec_id", "idx", footprints.sigmoid_mask(F.col("value") - 127.0).alias("mask"))


@query("""WITH m AS (SELECT p_partkey // 100 AS image_id, (p_partkey % 100) // 10 AS y, p_partkey % 10 AS x, CASE WHEN (p_partkey * p_partkey * 31 + p_partkey * 7) % 101 < 36 THEN 255 ELSE 0 END AS value FROM part),
r AS (SELECT s_suppkey % 7 AS image_id, s_suppkey AS ord, s_suppkey * 3 % 8 AS x1, s_suppkey * 5 % 8 AS y1, s_suppkey * 3 % 8 + s_suppkey % 4 AS x2, s_suppkey * 5 % 8 + s_suppkey % 3 AS y2, 100 + s_suppkey % 100 AS value FROM supplier)
SELECT m.image_id, m.y::INTEGER AS y, m.x::INTEGER AS x, coalesce(max_by(r.value, r.ord), any_value(m.value))::BIGINT AS value
FROM m LEFT JOIN r ON m.image_id = r.image_id AND m.x BETWEEN x1 AND x2 AND m.y BETWEEN y1 AND y2 GROUP BY 1, 2, 3""")
def raster_paint(spark, sf_dir):
    k = F.col("s_suppkey").cast("long")
    x, y = F.pmod(k * 3, F.lit(8)), F.pmod(k * 5, F.lit(8))
    r = read(spark, sf_dir, "supplier").select(F.pmod(k, F.lit(7)).alias("image_id"), k.alias("ord"), x.alias("x1"), y.alias("y1"), (x + F.pmod(k, F.lit(4))).alias("x2"), (y + F.pmod(k, F.lit(3))).alias("y2"), (100 + F.pmod(k, F.lit(100))).alias("value"))
    return footprints.rasterize(_mask(spark, sf_dir).withColumn("value", F.col("value").cast("long")), r)


@query("""SELECT l_suppkey AS image_a, l_linenumber AS image_b, count(*) AS fundamental_inliers, (row_number() OVER (ORDER BY count(*) DESC, l_suppkey, l_linenumber))::INTEGER AS rank FROM lineitem GROUP BY 1, 2""")
def pair_ranks(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_a"), F.col("l_linenumber").alias("image_b")).agg(F.count(F.lit(1)).alias("fundamental_inliers"))
    return pairs.ranked(li, "fundamental_inliers")


@query("""WITH li AS (SELECT l_suppkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
a AS (SELECT l_suppkey, (l_partkey * 37 % 640)::DOUBLE AS xa, ((l_partkey * 91 + q) % 480)::DOUBLE AS ya, l_partkey % 4 = 0 AS wrong FROM li),
b AS (SELECT *, CASE WHEN wrong THEN ya ELSE 0.9::DOUBLE * xa - 0.1::DOUBLE * ya + 12 END AS xb, CASE WHEN wrong THEN xa ELSE 0.1::DOUBLE * xa + 0.9::DOUBLE * ya - 5 END AS yb FROM a),
c AS (SELECT *, sqrt(pow(xb - (0.9::DOUBLE * xa - 0.1::DOUBLE * ya + 12), 2) + pow(yb - (0.1::DOUBLE * xa + 0.9::DOUBLE * ya - 5), 2)) AS off FROM b)
SELECT l_suppkey AS image_a, l_suppkey + 1 AS image_b, count(*)::INTEGER AS raw_matches, (CASE WHEN count(*) < 8 THEN 0 ELSE count(*) FILTER (off <= 3) END)::INTEGER AS homography_inliers FROM c GROUP BY 1""")
def ransac_homography(spark, sf_dir):
    """The right points follow one exact model, so its inliers are known."""
    return ransac(spark, sf_dir).select("image_a", "image_b", "raw_matches", "homography_inliers")


@query("""WITH f AS (SELECT 'Building' || s_suppkey AS name, s_suppkey AS number, (s_suppkey % 9)::INTEGER AS k FROM supplier ORDER BY s_suppkey LIMIT 20),
n AS (SELECT *, row_number() OVER (ORDER BY number) AS n FROM f)
SELECT printf('B%03d', n) AS building_id, name AS source_folder, k AS source_image_count, (8 + (3 * n) % 9)::INTEGER AS w, (18 + 22 * ((n - 1) % 5))::INTEGER AS x,
  'DATASET_DERIVED_PROTOTYPE' AS detection_status, 'PROTOTYPE_ESTIMATE' AS geometry_status FROM n""")
def folder_city(spark, sf_dir):
    """The city grid of the first twenty building folders, a limit that is the feature's own."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("Building"), "s_suppkey").alias("name"), F.pmod("s_suppkey", F.lit(9)).cast("int").alias("image_count"))
    city = footprints.city_of_folders(building_folders(s).join(s, "name"))
    return city.select("building_id", "source_folder", "source_image_count", "w", "x", "detection_status", "geometry_status")


@query("""SELECT l_linenumber AS epoch, avg(l_quantity) FILTER (l_suppkey % 5 <> 0) AS training_loss, avg(l_quantity) FILTER (l_suppkey % 5 = 0) AS validation_loss FROM lineitem GROUP BY 1""")
def mean_losses(spark, sf_dir):
    """Whole numbers stand for the losses, so that their sums don't hang on the order."""
    split = F.when(F.pmod("l_suppkey", F.lit(5)) == 0, "val").otherwise("train")
    return inventory.mean_losses(read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("epoch"), split.alias("split"), F.col("l_quantity").alias("loss")))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 6.0::DOUBLE WHEN 1 THEN 6.0::DOUBLE WHEN 2 THEN NULL ELSE p_size::DOUBLE END AS height, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE p_brand END AS status FROM part""")
def nested_defaults(spark, sf_dir):
    """Records with no measurements, without a height, with a null one, and whole ones: only what is missing takes the default."""
    k, size = F.pmod("p_partkey", F.lit(4)), F.col("p_size").cast("string")
    inner = F.when(k == 1, "{}").when(k == 2, '{"height": null}').otherwise(F.concat(F.lit('{"height": '), size, F.lit("}")))
    said = F.when(k == 0, "{}").otherwise(F.concat(F.lit('{"measurements": '), inner, F.lit(', "status": "'), "p_brand", F.lit('"}')))
    r = read(spark, sf_dir, "part").select("p_partkey", F.parse_json(said).alias("r"))
    return r.select("p_partkey", nested_get(F.col("r"), "$.measurements.height", "double", F.lit(6.0)).alias("height"), nested_get(F.col("r"), "$.status", "string", F.lit("unknown")).alias("status"))


@query(f"""WITH {_GRID} SELECT building_id, (w * w)::DOUBLE / 4 AS bow_tie, (w * w)::DOUBLE / 8 AS common, (4 * w * w)::DOUBLE AS wound_twice, false AS simple FROM g""")
def polygon_repair(spark, sf_dir):
    """Rings that cross themselves: a bow tie keeps one half, and what a ring goes around twice counts once."""
    x, z, w = F.col("x").cast("double"), F.col("z").cast("double"), F.col("w").cast("double")
    ring = lambda *points: F.array(*[F.array(x + a * w, z + b * w) for a, b in points])
    tie, half = ring((0, 0), (1, 1), (0, 1), (1, 0)), ring((0, 0), (0.5, 0), (0.5, 1), (0, 1))
    twice = ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0), (1, 0), (1, 1), (0, 1))
    g = _grid(spark, sf_dir).select("building_id", repaired(tie).alias("tie"), F.array(half).alias("half"), repaired(twice).alias("twice"), is_simple(tie).alias("simple"))
    return g.select("building_id", total_area(F.col("tie")).alias("bow_tie"), common_area(F.col("tie"), F.col("half")).alias("common"), total_area(F.col("twice")).alias("wound_twice"), "simple")
