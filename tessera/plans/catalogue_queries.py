"""Raster, object and catalogue queries.

``orders`` is a raster 150 pixels wide: x = key mod 150, y = key div 150, flux =
total price, label = priority.  The other tables stand in for manifests and catalogues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import areas, catalog, features, grid, objects
from ..operators.graph import components
from ..streaming import incremental
from .registry import query, table

WIDTH = 150
PIXELS = "px AS (SELECT o_orderkey AS idx, CAST(o_orderkey % 150 AS INTEGER) AS x, CAST(o_orderkey // 150 AS INTEGER) AS y, o_totalprice AS flux, o_orderpriority AS label FROM orders)"


def _pixels(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % WIDTH).cast("int").alias("x"), F.floor(F.col("o_orderkey") / WIDTH).cast("int").alias("y"), F.col("o_totalprice").alias("flux"), F.col("o_orderpriority").alias("label"))


def height(pixels: DataFrame) -> int:
    """Rows of a raster, from its pixels; 0 if there are none."""
    top = pixels.agg(F.max("y")).first()[0]
    return 0 if top is None else top + 1


#: The raster's pixels as five images, one for each order priority.
AREA = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
AREA_BOX = f"SELECT {AREA} AS area, 2 * {AREA} AS b, 60 + {AREA} AS t, {AREA} AS l, 40 + 3 * {AREA} AS r FROM orders GROUP BY ALL"


def _areas(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pixels with their image, and a rectangle for each image."""
    pixels = _pixels(spark, sf_dir).withColumn("area", F.substring("label", 1, 1).cast("int"))
    a = F.col("area")
    return pixels, pixels.select("area").distinct().select("area", (2 * a).alias("bottom"), (60 + a).alias("top"), a.alias("left"), (40 + 3 * a).alias("right"))


def _area_clip_sql(rounds: int, clip: float) -> str:
    parts = [f"b AS ({AREA_BOX})", f"k0 AS (SELECT area, o_totalprice AS f FROM orders JOIN b ON area = {AREA} WHERE o_totalprice <> 0 AND o_orderkey % {WIDTH} >= l AND o_orderkey % {WIDTH} < r AND o_orderkey // {WIDTH} >= b.b AND o_orderkey // {WIDTH} < t)"]
    out = []
    for r in range(rounds):
        parts.append(f"s{r} AS (SELECT area, count(*) AS n, avg(f) AS mean, median(f) AS median, stddev_pop(f) AS std FROM k{r} GROUP BY area)")
        parts.append(f"k{r + 1} AS (SELECT area, f FROM k{r} JOIN s{r} USING (area) WHERE f BETWEEN median - {clip} * std AND median + {clip} * std)")
        kept = f"WHERE n <> (SELECT n FROM s{r - 1} p WHERE p.area = s{r}.area)" if r else ""
        out.append(f"SELECT area, {r} AS round, n, round(mean, 3) AS mean, round(median, 3) AS median, round(std, 3) AS std FROM s{r} {kept}")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@query(_area_clip_sql(4, 1.5))
def area_clip(spark, sf_dir):
    """Clipping rounds of five images, each in a rectangle of its own, by the same passes."""
    pixels, boxes = _areas(spark, sf_dir)
    found = areas.clipped(areas.crop_to(pixels, boxes), ["area"], "flux", 1.5, 4)
    return found.select("area", "round", "n", *(F.round(c, 3).alias(c) for c in ("mean", "median", "std")))


@query(f"WITH b AS ({AREA_BOX}) SELECT area, CAST(unnest(range(l + 3, r - 2, 4)) AS INTEGER) AS gx, gy FROM (SELECT *, CAST(unnest(range(b.b + 3, t - 2, 4)) AS INTEGER) AS gy FROM b)")
def area_scan(spark, sf_dir):
    """Grid points of five images, each in a rectangle of its own."""
    return areas.scan_boxes(_areas(spark, sf_dir)[1], 3, 4)


# --- manifests -----------------------------------------------------------------------

FIRST = "f AS (SELECT * FROM (SELECT c_nationkey AS area_id, c_mktsegment AS band, c_custkey AS file_id, c_name AS file_name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1)"


def _files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("area_id"), F.col("c_mktsegment").alias("band"), F.col("c_custkey").alias("file_id"), F.col("c_name").alias("file_name"))


@query(f"WITH {FIRST}, a AS (SELECT n_nationkey AS area_id, n_name AS field FROM nation WHERE n_regionkey < 3) SELECT area_id, field, band, file_id, file_name FROM a FULL JOIN f USING (area_id)")
def manifest_join(spark, sf_dir):
    areas = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("field"))
    return catalog.attach_files(areas, _files(spark, sf_dir)).select("area_id", "field", "band", "file_id", "file_name")


@query("SELECT c_nationkey AS area_id, count(DISTINCT c_mktsegment) AS n_bands FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) >= 4")
def complete_areas(spark, sf_dir):
    return catalog.complete_areas(_files(spark, sf_dir), 4)


@query("SELECT n_nationkey AS area_id, n_name AS field FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 12)")
def unprocessed_areas(spark, sf_dir):
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("field"))
    done = table(spark, sf_dir, "supplier").where("s_suppkey < 12").select(F.col("s_nationkey").alias("area_id"))
    return incremental.pending(areas, done, "area_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def band_filter(spark, sf_dir):
    return grid.bands(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["MACHINERY", "BUILDING"], "c_mktsegment")


@query("SELECT r_name AS field, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, band, r_name || '/' || lpad(CAST(i AS VARCHAR), 2, '0') || '-' || CAST(j AS VARCHAR) || '-' || band || '.fits' AS path FROM region CROSS JOIN range(9) a(i) CROSS JOIN range(9) b(j) CROSS JOIN (SELECT unnest(['g', 'i', 'r']) AS band)")
def tile_paths(spark, sf_dir):
    fields = table(spark, sf_dir, "region").select(F.col("r_name").alias("field"))
    return catalog.cross_tiles(spark, fields, 9, 9, ["g", "r", "i"], "%s/%02d-%d-%s.fits")


@query("SELECT name, regexp_extract(name, '^([A-Za-z]+)-([0-9]+)', 1) AS band, regexp_extract(name, '^([A-Za-z]+)-([0-9]+)', 2) AS region, CAST(dense_rank() OVER (ORDER BY regexp_extract(name, '^([A-Za-z]+)-([0-9]+)', 2)) - 1 AS INTEGER) AS area_id, CAST((dense_rank() OVER (ORDER BY regexp_extract(name, '^([A-Za-z]+)-([0-9]+)', 2)) - 1) // 10 AS INTEGER) AS file_no FROM (SELECT c_mktsegment || '-' || c_nationkey || '.fits' AS name FROM customer)")
def regex_manifest(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.concat_ws("", "c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"), F.lit(".fits")).alias("name"))
    return catalog.manifest(names).withColumn("area_id", F.col("area_id").cast("int"))


@query("SELECT replace(replace(s_name, '#', '-'), ',', '-') AS name FROM supplier")
def bulk_rename(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.translate("s_name", "#,", "--").alias("name"))


# --- rasters ---------------------------------------------------------------------------


@query(f"WITH {PIXELS} SELECT idx FROM px WHERE x >= 20 + 3 AND x < 120 - 3 AND y >= 10 + 3 AND y < 80 - 3")
def field_crop(spark, sf_dir):
    return grid.crop(_pixels(spark, sf_dir), 10, 80, 20, 120, 3).select("idx")


@query("SELECT idx, CAST(CASE WHEN b1 > m * s1 OR b2 > m * s2 OR b3 > m * s3 THEN 1 ELSE 0 END AS INTEGER) AS hit, sigma FROM (SELECT o_orderkey AS idx, o_totalprice AS b1, o_custkey * 1.0 AS b2, (o_orderkey * 7919) % 1000 AS b3 FROM orders), (SELECT stddev_pop(o_totalprice) AS s1, stddev_pop(o_custkey) AS s2, stddev_pop((o_orderkey * 7919) % 1000) AS s3 FROM orders), (SELECT unnest([3.25, 3.4]) AS m, unnest([325, 340]) AS sigma)")
def sigma_mask(spark, sf_dir):
    bands = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("b1"), F.col("o_custkey").cast("double").alias("b2"), ((F.col("o_orderkey") * 7919) % 1000).cast("double").alias("b3"))
    s = bands.agg(*(F.stddev_pop(f"b{i}").alias(f"s{i}") for i in (1, 2, 3)))
    both = bands.crossJoin(F.broadcast(s))
    one = lambda m: both.select("idx", grid.sigma_mask(["b1", "b2", "b3"], [F.col("s1"), F.col("s2"), F.col("s3")], m).alias("hit"), F.lit(int(100 * m)).alias("sigma"))
    return one(3.25).unionByName(one(3.4))


@query("SELECT o_orderkey AS idx, CAST(o_totalprice > 5 * 60000 AS INTEGER) AS flux_5, CAST(o_totalprice > 8 * 60000 AS INTEGER) AS flux_8 FROM orders")
def sigma_levels(spark, sf_dir):
    return _pixels(spark, sf_dir).select("idx", *grid.sigma_levels(["flux"], [60000.0], [5, 8]))


@query("SELECT o_orderkey AS idx, CASE WHEN o_totalprice < 200000 THEN 0.0 ELSE o_totalprice END AS flux FROM orders")
def pixel_threshold(spark, sf_dir):
    return _pixels(spark, sf_dir).select("idx", grid.pixel_threshold(F.col("flux"), 200000).alias("flux"))


@query("SELECT c_custkey, c_acctbal = 0 OR c_nationkey = 0 AS any_zero, c_acctbal <= 0 AND c_nationkey <= 0 AS all_dark, c_acctbal < 500 AND c_nationkey < 5 AS all_faint FROM customer")
def zero_tests(spark, sf_dir):
    tests = grid.zero_tests(["c_acctbal", "c_nationkey"], [500.0, 5.0])
    return table(spark, sf_dir, "customer").select("c_custkey", *(c.alias(n) for n, c in tests.items()))


def _clip_sql(rounds: int, clip: float) -> str:
    parts, out = ["k0 AS (SELECT o_totalprice AS f FROM orders WHERE o_totalprice <> 0)"], []
    for r in range(rounds):
        parts.append(f"s{r} AS (SELECT count(*) AS n, avg(f) AS mean, median(f) AS median, stddev_pop(f) AS std FROM k{r})")
        parts.append(f"k{r + 1} AS (SELECT f FROM k{r}, s{r} WHERE f BETWEEN median - {clip} * std AND median + {clip} * std)")
        out.append(f"SELECT CAST({r} AS BIGINT) AS round, n, round(mean, 3) AS mean, round(median, 3) AS median, round(std, 3) AS std FROM s{r}")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@query(_clip_sql(4, 1.5))
def sigma_clip(spark, sf_dir):
    found = grid.sigma_clip(_pixels(spark, sf_dir), "flux", 1.5, 4)
    rows = [(i, n, *map(float, rest)) for i, (n, *rest) in enumerate(found)]
    made = spark.createDataFrame(rows, "round long, n long, mean double, median double, std double")
    return made.select("round", "n", *(F.round(c, 3).alias(c) for c in ("mean", "median", "std")))


@query("SELECT round(avg(o_totalprice), 3) AS mean, round(stddev_pop(o_totalprice), 3) AS std, round(sqrt(avg(o_totalprice * o_totalprice)), 3) AS rms FROM orders")
def background_stats(spark, sf_dir):
    return grid.background_stats(_pixels(spark, sf_dir), "flux").select(*(F.round(c, 3).alias(c) for c in ("mean", "std", "rms")))


@query(f"""WITH {PIXELS}, z AS (SELECT max(y) + 1 AS z FROM px), h AS (SELECT k, z, greatest(CAST(0.2 * 150 AS INTEGER), 20) * (1 + 0.1 * k) / 2 AS hx, greatest(CAST(floor(0.2 * z) AS INTEGER), 20) * (1 + 0.1 * k) / 2 AS hy FROM range(10) t(k), z),
b AS (SELECT k, greatest(0, CAST(trunc(75 - hx) AS INTEGER)) AS l, least(150, CAST(trunc(75 + hx) AS INTEGER)) AS r, greatest(0, CAST(trunc(z / 2.0 - hy) AS INTEGER)) AS bo, least(z, CAST(trunc(z / 2.0 + hy) AS INTEGER)) AS t FROM h UNION ALL SELECT 10, 0, 150, 0, z FROM z),
s AS (SELECT k, l, r, bo, t, avg(CASE WHEN flux > 330000 THEN 1.0 ELSE 0.0 END) AS filled FROM b LEFT JOIN px ON x >= l AND x < r AND y >= bo AND y < t GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, l AS "left", r AS "right", bo AS bottom, t AS top, round(filled, 6) AS filled FROM s WHERE filled > 0.34 OR k = 10 ORDER BY k LIMIT 1""")
def background_region(spark, sf_dir):
    lit = _pixels(spark, sf_dir).withColumn("flux", F.when(F.col("flux") > 330000, 1.0).otherwise(0.0))
    return grid.background_region(lit, "flux", WIDTH, height(lit), 20, 0.34).withColumn("filled", F.round("filled", 6))


GRID = "g AS (SELECT CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy FROM range(4, 146, 8) a(gx) CROSS JOIN (SELECT unnest(range(4, max(y) + 1, 8)) AS gy FROM px))"
PATCHES = f"{PIXELS}, {GRID}, pt AS (SELECT gx, gy, x - gx AS dx, y - gy AS dy, flux FROM g JOIN px ON x >= gx - 3 AND x < gx + 3 AND y >= gy - 3 AND y < gy + 3)"


def _grid(pixels: DataFrame) -> DataFrame:
    return grid.scan_grid(pixels.sparkSession, 4, height(pixels), 4, 146, 8)


@query(f"WITH {PATCHES} SELECT gx, gy, count(*) AS n, round(sum(flux), 2) AS total, count(*) FILTER (flux > 200000) AS bright FROM pt GROUP BY ALL")
def scan_patches(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    p = grid.patches(pixels, _grid(pixels), 3)
    return p.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.round(F.sum("flux"), 2).alias("total"), F.sum(F.when(F.col("flux") > 200000, 1).otherwise(0)).alias("bright"))


@query(f"WITH {PATCHES} SELECT gx, gy FROM pt GROUP BY ALL HAVING max(CASE WHEN dx = 0 AND dy = 0 THEN flux END) > 250000 AND count(*) FILTER (flux >= 60000) >= 0.8 * 36")
def patch_accept(spark, sf_dir):
    dark = _pixels(spark, sf_dir).withColumn("flux", grid.pixel_threshold(F.col("flux"), 60000))
    rows = grid.patch_vectors(dark, _grid(dark), 3, ["flux"])
    return grid.accepted(rows.where("n = 36"), 3, {"flux": 250000.0}).select("gx", "gy")


@query(f"WITH {PATCHES} SELECT gx, gy, round(sum(CASE WHEN flux < 200000 THEN 0 ELSE flux END), 2) AS kept FROM pt GROUP BY ALL HAVING count(*) = 36")
def patch_threshold(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    rows = grid.patch_vectors(pixels, _grid(pixels), 3, ["flux"]).where("n = 36")
    return rows.select("gx", "gy", F.round(V.total(grid.patch_threshold("flux", 200000)), 2).alias("kept"))


@query(f"WITH {PATCHES} SELECT gx, gy, CAST(floor(sqrt((dx + 0.5) * (dx + 0.5) + (dy + 0.5) * (dy + 0.5))) AS INTEGER) AS ring, count(*) AS n, round(avg(flux), 6) AS mean FROM pt GROUP BY ALL")
def azimuthal_profile(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    p = grid.patches(pixels, _grid(pixels), 3)
    return features.azimuthal_profile(p, "flux").withColumn("mean", F.round("mean", 6))


@query()
def power_spectrum(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    rows = grid.patch_vectors(pixels, _grid(pixels), 3, ["flux"])
    return features.patch_features(rows, ["flux"], 6).select("gx", "gy", F.transform("v", lambda x: F.round(F.ln(x + 1), 5)).alias("v"))


@query(f"WITH {PIXELS} SELECT CAST(x // 10 AS BIGINT) AS tx, CAST(y // 10 AS BIGINT) AS ty, count(*) FILTER (flux > 90000) AS good, count(*) FILTER (flux <= 90000) AS bad, round(stddev_pop(CASE WHEN flux > 90000 THEN flux ELSE 0 END), 3) AS std FROM px GROUP BY ALL HAVING count(*) FILTER (flux > 90000) > 4.0 * count(*) FILTER (flux <= 90000)")
def good_tiles(spark, sf_dir):
    lit = _pixels(spark, sf_dir).select(F.floor(F.col("x") / 10).alias("tx"), F.floor(F.col("y") / 10).alias("ty"), F.when(F.col("flux") > 90000, F.col("flux")).otherwise(0.0).alias("flux"))
    return grid.good_tiles(lit, ["tx", "ty"], "flux").withColumn("std", F.round("std", 3))


CROSS = "CROSS JOIN (SELECT unnest([0, 1, -1, 0, 0]) AS i, unnest([0, 0, 0, 1, -1]) AS j)"


@query(f"""WITH RECURSIVE {PIXELS}, m AS (SELECT x, y FROM px WHERE flux > 120000),
er AS (SELECT x + i AS x, y + j AS y FROM m {CROSS} GROUP BY ALL HAVING count(*) = 5),
di AS (SELECT DISTINCT x + i AS x, y + j AS y FROM er {CROSS}),
n AS (SELECT y * 1000 + x AS id, x, y FROM di), e AS (SELECT a.id AS s, b.id AS t FROM n a JOIN n b ON abs(a.x - b.x) + abs(a.y - b.y) = 1),
r AS (SELECT id, id AS root FROM n UNION SELECT t, root FROM r JOIN e ON s = id),
c AS (SELECT id, min(root) AS region FROM r GROUP BY id)
SELECT CAST(region AS BIGINT) AS region, count(*) AS n FROM c GROUP BY region HAVING count(*) >= 5""")
def good_region(spark, sf_dir):
    mask = _pixels(spark, sf_dir).where("flux > 120000").select("x", "y")
    opened = grid.morphology(grid.morphology(mask, True), False)
    nodes = opened.select((F.col("y") * 1000 + F.col("x")).cast("long").alias("node"), "x", "y")
    right = nodes.select(F.col("node").alias("src"), F.explode(F.array(F.struct((F.col("x") + 1).alias("x"), "y"), F.struct("x", (F.col("y") + 1).alias("y")))).alias("p")).select("src", "p.x", "p.y")
    edges = right.join(nodes, ["x", "y"]).select("src", F.col("node").alias("dst"))
    return components(nodes, edges).groupBy(F.col("component").alias("region")).agg(F.count("*").alias("n")).where("n >= 5")


# --- objects -----------------------------------------------------------------------------

MASKED = f"{PIXELS}, m AS (SELECT * FROM px WHERE flux > 400000)"
EDGES = "e AS (SELECT a.idx AS s, b.idx AS t FROM m a JOIN m b ON a.idx <> b.idx AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)"
COMPONENTS = f"{MASKED}, {EDGES}, r AS (SELECT idx, idx AS root FROM m UNION SELECT t, root FROM r JOIN e ON s = idx), o AS (SELECT idx, min(root) AS object FROM r GROUP BY idx), k AS (SELECT m.*, object FROM m JOIN o USING (idx))"


def _masked(spark, sf_dir, flux: float = 400000) -> DataFrame:
    return _pixels(spark, sf_dir).where(F.col("flux") > flux)


def _labelled(spark, sf_dir) -> DataFrame:
    m = _masked(spark, sf_dir)
    return m.join(objects.objects(m, 1), "idx").checkpoint()


@query(f"WITH {MASKED}, {EDGES} SELECT s AS src, t AS dst FROM e WHERE s < t")
def neighbours_chebyshev(spark, sf_dir):
    return objects.neighbours(_masked(spark, sf_dir), 1)


@query(f"WITH RECURSIVE {COMPONENTS} SELECT idx, object FROM o")
def pixel_components(spark, sf_dir):
    return objects.objects(_masked(spark, sf_dir), 1)


@query(f"WITH RECURSIVE {MASKED}, e AS (SELECT a.idx AS s, b.idx AS t FROM m a JOIN m b ON a.idx <> b.idx AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND a.label = b.label), r AS (SELECT idx, idx AS root FROM m UNION SELECT t, root FROM r JOIN e ON s = idx) SELECT idx, min(root) AS object FROM r GROUP BY idx")
def components_same_label(spark, sf_dir):
    return objects.objects(_masked(spark, sf_dir), 2, same="label")


@query("WITH RECURSIVE e AS (SELECT o_orderkey AS s, o_orderkey + 1 AS t FROM orders WHERE o_totalprice > 250000), n AS (SELECT s AS id FROM e UNION SELECT t FROM e), b AS (SELECT s, t FROM e UNION ALL SELECT t, s FROM e), r AS (SELECT id, id AS root FROM n UNION SELECT t, root FROM r JOIN b ON s = id) SELECT id AS node, min(root) AS component FROM r GROUP BY id")
def graph_components(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"))
    return components(edges.select(F.explode(F.array("src", "dst")).alias("node")), edges)


@query("WITH e AS (SELECT o_orderkey AS s, o_custkey AS t FROM orders WHERE o_totalprice > 300000 AND o_orderkey <> o_custkey), b AS (SELECT s, t FROM e UNION ALL SELECT t, s FROM e) SELECT s AS node, count(*) AS degree FROM b GROUP BY s")
def node_degrees(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").where("o_totalprice > 300000 and o_orderkey <> o_custkey").select(F.col("o_orderkey").alias("s"), F.col("o_custkey").alias("t"))
    return edges.select(F.explode(F.array("s", "t")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))



def _level_sql() -> str:
    def level(tag: str, flux: int) -> str:
        return f"m{tag} AS (SELECT * FROM px WHERE flux > {flux}), e{tag} AS (SELECT a.idx AS s, b.idx AS t FROM m{tag} a JOIN m{tag} b ON a.idx <> b.idx AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), r{tag} AS (SELECT idx, idx AS root FROM m{tag} UNION SELECT t, root FROM r{tag} JOIN e{tag} ON s = idx), o{tag} AS (SELECT idx, min(root) AS object FROM r{tag} GROUP BY idx), k{tag} AS (SELECT idx, object FROM o{tag} WHERE object IN (SELECT object FROM o{tag} GROUP BY object HAVING count(*) > 1))"

    return f"WITH RECURSIVE {PIXELS}, {level('h', 430000)}, {level('l', 390000)} SELECT idx, object, CAST(0 AS INTEGER) AS level FROM kh UNION ALL SELECT idx, object, 1 FROM kl WHERE object NOT IN (SELECT object FROM kl WHERE idx IN (SELECT idx FROM kh))"


@query(_level_sql())
def level_merge(spark, sf_dir):
    levels = [m.join(objects.objects(m, 1), "idx").checkpoint() for m in (_masked(spark, sf_dir, f) for f in (430000, 390000))]
    return objects.merge_levels(levels)


@query(f"WITH RECURSIVE {COMPONENTS} SELECT object, label, count(*) AS n FROM k GROUP BY ALL")
def object_hist(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return rows.groupBy("object", "label").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT object, count(*) AS n_patches, min(x) - 1 AS \"left\", max(x) + 1 AS \"right\", min(y) - 1 AS top, max(y) + 1 AS bottom, CAST(trunc(avg(x)) AS INTEGER) AS centre_x, CAST(trunc(avg(y)) AS INTEGER) AS centre_y FROM k GROUP BY object")
def object_boxes(spark, sf_dir):
    return objects.boxes(_labelled(spark, sf_dir), 1).drop("first")


CATALOGUE = f"""{COMPONENTS}, b AS (SELECT object, count(*) AS n, min(x) - 1 AS l, max(x) + 1 AS r, min(y) - 1 AS t, max(y) + 1 AS b, CAST(trunc(avg(x)) AS INTEGER) AS cx, CAST(trunc(avg(y)) AS INTEGER) AS cy, min(x * 100000 + y) AS first FROM k GROUP BY object),
q AS (SELECT *, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS object_id, greatest(r - l, b - t) AS side FROM b)"""


@query(f"WITH RECURSIVE {CATALOGUE} SELECT object_id, n AS n_patches, r - l AS width, b - t AS height, cx - side // 2 AS cut_left, cx + side // 2 AS cut_right, cy - side // 2 AS cut_top, cy + side // 2 AS cut_bottom, cx AS centre_x, cy AS centre_y, l AS br_left, l + side AS br_right, t AS br_top, t + side AS br_bottom FROM q WHERE n >= 2")
def object_catalogue(spark, sf_dir):
    return objects.catalogue(_labelled(spark, sf_dir), 1, 2)


@query(f"WITH RECURSIVE {CATALOGUE} SELECT 'circle(' || cx || ', ' || cy || ', 25) # text={{' || object_id || '}} color=cyan' AS line FROM q WHERE n >= 2")
def ds9_regions(spark, sf_dir):
    return objects.regions(objects.catalogue(_labelled(spark, sf_dir), 1, 2))


@query(f"WITH {PIXELS} SELECT label, count(*) AS n FROM px GROUP BY label")
def cluster_sizes(spark, sf_dir):
    return objects.sizes(_pixels(spark, sf_dir), "label")


@query("SELECT idx, greatest(0, least(x - 5, 150)) AS \"left\", greatest(0, least(x + 5, 150)) AS \"right\", greatest(0, least(h - y - 5, h)) AS top, greatest(0, least(h - y + 5, h)) AS bottom FROM (SELECT o_orderkey AS idx, CAST(o_orderkey % 150 AS INTEGER) AS x, CAST(o_orderkey // 150 AS INTEGER) AS y, CAST(1 + max(o_orderkey // 150) OVER () AS INTEGER) AS h FROM orders)")
def cutout_boxes(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    return pixels.select("idx", *objects.cutout(F.col("x"), F.col("y"), 10, WIDTH, height(pixels), True))


@query("SELECT c_custkey FROM customer WHERE (c_custkey >= 0 AND c_nationkey >= 0 AND c_acctbal >= 0) AND (c_nationkey - c_custkey >= 5 OR c_acctbal - c_nationkey >= 5 OR c_custkey >= 2)")
def cutout_eligible(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("b", F.col("c_acctbal")).where((F.col("c_acctbal") >= 0) & objects.eligible("c_custkey", "c_nationkey", "c_nationkey", "b", "c_custkey")).select("c_custkey")


@query(f"WITH RECURSIVE {CATALOGUE}, c AS (SELECT object_id, cx - side // 2 - 2 AS l, cx + side // 2 + 2 AS r, cy - side // 2 - 2 AS t, cy + side // 2 + 2 AS b FROM q WHERE n >= 2 AND 2 * (side // 2) >= 3) SELECT object_id, count(*) AS n, round(sum(flux), 2) AS total FROM c JOIN px ON x >= c.l AND x < c.r AND y >= c.t AND y < c.b GROUP BY object_id")
def cutout_pixels(spark, sf_dir):
    cut = objects.cut_pixels(_pixels(spark, sf_dir), objects.catalogue(_labelled(spark, sf_dir), 1, 2), 2, 3, 16)
    return cut.groupBy("object_id").agg(F.count("*").alias("n"), F.round(F.sum("flux"), 2).alias("total"))


@query(f"WITH {MASKED}, s AS (SELECT label, count(*) AS n FROM m GROUP BY label), u AS (SELECT x + i AS x, y + j AS y, n, label FROM m JOIN s USING (label) CROSS JOIN range(-1, 1) a(i) CROSS JOIN range(-1, 1) b(j)) SELECT px.x, px.y, first(u.label ORDER BY n DESC, u.label) AS label FROM px JOIN u ON u.x = px.x AND u.y = px.y GROUP BY px.x, px.y")
def segmentation(spark, sf_dir):
    return objects.painted(_pixels(spark, sf_dir), _masked(spark, sf_dir), 1)


# --- catalogues ----------------------------------------------------------------------------


FIELDS = [(0, 189.2, 62.2, 75.0, 40.0, 0.01), (1, 34.4, -5.2, 70.0, 30.0, 0.02), (2, 359.99, -27.8, 10.0, 10.0, 0.015)]


@query(f"""WITH f AS (SELECT * FROM (VALUES {', '.join(map(str, FIELDS))}) t(field, ra0, dec0, x0, y0, s)), o AS (SELECT CAST(p_partkey % 4 AS INTEGER) AS field, p_partkey AS object_id, CAST(p_partkey % 150 AS INTEGER) AS x, p_size AS y FROM part),
g AS (SELECT o.*, dec0, ra0, radians((x0 - x) * s) AS xi, radians((y - y0) * s) AS eta FROM o LEFT JOIN f USING (field)),
w AS (SELECT *, ra0 + degrees(atan2(xi, cos(radians(dec0)) - eta * sin(radians(dec0)))) AS ra, degrees(atan2(sin(radians(dec0)) + eta * cos(radians(dec0)), sqrt(pow(xi, 2) + pow(cos(radians(dec0)) - eta * sin(radians(dec0)), 2)))) AS dec FROM g)
SELECT field, object_id, CAST(coalesce(s_nationkey, -1) AS INTEGER) AS label, round(CASE WHEN ra < 0 THEN ra + 360 WHEN ra >= 360 THEN ra - 360 ELSE ra END, 6) AS ra, round(dec, 6) AS dec FROM w LEFT JOIN supplier ON s_suppkey = object_id""")
def field_catalogue(spark, sf_dir):
    found = table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).cast("int").alias("field"), F.col("p_partkey").alias("object_id"), (F.col("p_partkey") % 150).cast("int").alias("centre_x"), F.col("p_size").alias("centre_y"), F.lit(1).alias("n_patches"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    labels = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).cast("int").alias("field"), F.col("s_suppkey").alias("object_id"), F.col("s_nationkey").alias("label"))
    fields = spark.createDataFrame(FIELDS, "field int, ra0 double, dec0 double, x0 double, y0 double, scale double")
    return catalog.field_catalogue(found, labels, fields).select("field", "object_id", F.col("label").cast("int").alias("label"), F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def label_matrix(spark, sf_dir):
    return catalog.label_matrix(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def in_sorted(spark, sf_dir):
    return catalog.in_sorted(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")


@query("SELECT o_orderstatus, o_orderpriority, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def topk_by_cut(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey", "o_totalprice")
    return catalog.top_by_cut(rows, "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey", 5).drop("o_totalprice")


@query("SELECT event_id, CAST(sum(CASE WHEN user_id < prev THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ordinal FROM (SELECT *, lag(user_id) OVER (ORDER BY ts, event_id) AS prev FROM events)")
def image_ordinal(spark, sf_dir):
    return catalog.ordinals(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "ordinal")


@query("SELECT event_id, CAST(sum(CASE WHEN user_id > nxt THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ordinal FROM (SELECT *, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events)")
def image_ordinal_early(spark, sf_dir):
    return catalog.ordinals(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], late=False).select("event_id", "ordinal")


@query("SELECT c_custkey, CAST(coalesce(o, -1) AS BIGINT) AS o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1 HAVING count(*) = 1) ON o_custkey = c_custkey")
def group_crossmatch(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey")
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return catalog.unique_match(left, right, ["c_custkey"], "o_orderkey")


@query("SELECT o_orderpriority, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 16")
def group_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return catalog.top_by_group(rows, "o_orderpriority", "o_totalprice", "o_orderkey", 16).drop("o_totalprice")


SKY = """a AS (SELECT c_custkey AS id, (c_custkey * 37) % 360 + (c_custkey % 7) / 10.0 AS ra, (c_custkey * 11) % 170 - 85 + (c_custkey % 5) / 10.0 AS dec FROM customer),
b AS (SELECT p_partkey AS id, (p_partkey * 37) % 360 + (p_partkey % 3) / 10.0 AS ra, (p_partkey * 11) % 170 - 85 + (p_partkey % 4) / 10.0 AS dec FROM part)"""


@query(f"""WITH {SKY}, s AS (SELECT a.id, b.id AS match_id, degrees(2 * asin(least(1.0, sqrt(pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2))))) AS sep FROM a JOIN b ON abs(a.dec - b.dec) <= 0.5)
SELECT id, match_id, round(sep, 6) AS sep FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sep, 9), match_id) AS r FROM s WHERE sep <= 0.45) WHERE r = 1""")
def sky_match(spark, sf_dir):
    def place(name: str, key: str, m: int, k: int) -> DataFrame:
        n = F.col(key)
        return table(spark, sf_dir, name).select(n.alias("id"), ((n * 37) % 360 + (n % m) / 10).alias("ra"), ((n * 11) % 170 - 85 + (n % k) / 10).alias("dec"))

    found = catalog.sky_match(place("customer", "c_custkey", 7, 5), place("part", "p_partkey", 3, 4), 0.45, right_id="id").toDF("id", "match_id", "sep")
    return found.withColumn("sep", F.round("sep", 6))


@query("SELECT o_custkey AS id, o_orderkey, round(o_totalprice, 2) AS z FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) JOIN customer ON c_custkey = o_custkey WHERE r = 1")
def first_match(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.round("o_totalprice", 2).alias("z"))
    return catalog.first_match(left, right, "id", "o_orderkey")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def label_lookup_default(spark, sf_dir):
    return catalog.with_default(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", -1)


@query("SELECT vec_id, coalesce(['red', 'green', 'blue'][CASE WHEN label % 4 < 3 THEN label % 4 + 1 END], '128,0,128') AS colour FROM embeddings")
def colour_lookup(spark, sf_dir):
    palette = spark.createDataFrame([(0, "red"), (1, "green"), (2, "blue")], "slot int, colour string")
    return catalog.colours(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", palette, 4).select("vec_id", "colour")


@query("SELECT 1 AS field, CAST(doc_id AS BIGINT) AS id, length(text) AS size FROM documents UNION ALL SELECT 2, item_id, length(text) FROM benchmark")
def catalogue_union(spark, sf_dir):
    from ..sources.tables import combined

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("size"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("size"))
    return combined({1: docs, 2: items}, ["id", "size"])


@query("SELECT DISTINCT o_custkey FROM orders")
def distinct_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey").distinct()


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def common_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT c_nationkey AS grp, count(*) AS n, round(avg(c_acctbal), 4) AS c_acctbal, round(stddev_samp(c_acctbal), 4) AS c_acctbal_std FROM customer GROUP BY 1")
def group_properties(spark, sf_dir):
    rows = catalog.group_properties(table(spark, sf_dir, "customer").withColumn("grp", F.col("c_nationkey")), "grp", ["c_acctbal"])
    return rows.select("grp", "n", F.round("c_acctbal", 4).alias("c_acctbal"), F.round("c_acctbal_std", 4).alias("c_acctbal_std"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'minus' ELSE 'plus' END || replace(printf('%.4f', abs(c_acctbal)), '.', 'dot') AS name, round(c_acctbal, 4) AS back FROM customer")
def signed_name_roundtrip(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select("c_custkey", catalog.signed_name(F.col("c_acctbal")).alias("name"))
    return named.select("c_custkey", "name", F.round(catalog.signed_value(F.col("name")), 4).alias("back"))


@query("SELECT o_orderpriority, string_agg('<img src=\"' || o_orderkey || '.png\">', '' ORDER BY rank) AS html FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 16 GROUP BY 1")
def html_montage(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return catalog.html_montage(rows, "o_orderpriority", "o_totalprice", "o_orderkey", 16)


@query("SELECT CAST(k AS BIGINT) AS s_nationkey, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS keys FROM range(31) t(k) LEFT JOIN supplier ON s_nationkey = k GROUP BY k")
def missing_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("s_nationkey"), "s_suppkey")
    return catalog.missing_filled(rows, spark, "s_nationkey", "s_suppkey", 30).select("s_nationkey", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@query("SELECT o_orderkey AS idx, CAST(floor(sqrt((x - 75) * (x - 75) + (y - 5) * (y - 5))) AS INTEGER) AS dist FROM (SELECT o_orderkey, o_orderkey % 150 AS x, o_orderkey // 150 AS y FROM orders)")
def centre_distance(spark, sf_dir):
    return _pixels(spark, sf_dir).select("idx", V.centre_distance("x", "y", F.lit(75), F.lit(5)).alias("dist"))


@query("SELECT c_custkey, printf('%02d:%02d:%02d.%02d', t // 360000, t // 6000 % 60, t // 100 % 60, t % 100) AS ra, printf('%s%02d:%02d:%02d.%d', CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END, a // 36000, a // 600 % 60, a // 10 % 60, a % 10) AS dec FROM (SELECT c_custkey, c_acctbal, CAST(round(c_custkey % 360 * 24000) AS BIGINT) AS t, CAST(round(abs(c_acctbal / 128) * 36000) AS BIGINT) AS a FROM customer)")
def sexagesimal_names(spark, sf_dir):
    ra, dec = catalog.sexagesimal(F.col("c_custkey") % 360, F.col("c_acctbal") / 128)
    return table(spark, sf_dir, "customer").select("c_custkey", ra.alias("ra"), dec.alias("dec"))


@query("SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n, event_type FROM events GROUP BY event_type")
def stream_stats(spark, sf_dir):
    import uuid

    from ..operators.graph import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_type", "value", F.dayofmonth("ts").alias("day"))
    events.repartition(4, "day").write.parquet(f"{root}/source")
    incremental.run_stats(spark, f"{root}/source", events.schema, "value", ["event_type"], f"{root}/state", f"{root}/checkpoint")
    found = incremental.stats(spark, f"{root}/state", ["event_type"])
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
