"""Vector queries over ``embeddings`` (64 values, as four bands of 16) and numeric columns of ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import assign, catalog, cluster, index, linkage, trees, weight
from .registry import query, table

DIM = 64


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


def _centres(points: DataFrame) -> DataFrame:
    return assign.centroids(points, "label", "v", DIM)


LONG = "e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"
CENTRES = "c AS (SELECT label AS cid, i, avg(x) AS x FROM e GROUP BY ALL)"
DISTANCES = "d AS (SELECT vec_id, cid, sum((e.x - c.x) * (e.x - c.x)) AS dist FROM e JOIN c USING (i) GROUP BY ALL)"
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), cid) AS rank FROM d)"


@query(f"WITH {LONG}, {CENTRES}, {DISTANCES}, {RANKED} SELECT vec_id, cid, round(dist, 6) AS dist FROM r WHERE rank = 1")
def nn_assign(spark, sf_dir):
    points = _points(spark, sf_dir)
    return assign.nearest(points, _centres(points), strategy="expression").withColumn("dist", F.round("dist", 6))


@query(f"WITH {LONG}, {CENTRES}, {DISTANCES}, {RANKED} SELECT vec_id, cid, round(dist, 6) AS dist FROM r WHERE rank = 1")
def nn_matrix(spark, sf_dir):
    points = _points(spark, sf_dir)
    return assign.nearest(points, _centres(points), strategy="matrix").withColumn("dist", F.round("dist", 6))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS cid, list_distance(a.v, b.v) AS dist FROM v a CROSS JOIN v b),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), cid) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, cid, round(dist, 6) AS dist FROM r WHERE rank <= 4""")
def nn_index(spark, sf_dir):
    """Every vector's four nearest ones, itself first, by the index over all vectors."""
    points = _points(spark, sf_dir)
    found = index.indexed_neighbours(points, points.select(F.col("vec_id").alias("cid"), F.col("v").alias("centre")), "euclidean", 4)
    return found.withColumn("dist", F.round("dist", 6))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, b.vec_id AS cid, round(list_cosine_distance(a.v, b.v), 6) AS dist FROM v a CROSS JOIN v b WHERE list_cosine_distance(a.v, b.v) < 0.75 AND a.vec_id <> b.vec_id""")
def radius_index(spark, sf_dir):
    """All pairs of vectors with a cosine distance below three quarters, by the index."""
    points = _points(spark, sf_dir)
    found = index.indexed_neighbours(points, points.select(F.col("vec_id").alias("cid"), F.col("v").alias("centre")), "cosine", None, 0.75, ranked=False)
    return found.where("vec_id <> cid").select("vec_id", "cid", F.round("dist", 6).alias("dist"))


ORDER_PLACE = "o_orderkey AS id, [o_totalprice / 1000, CAST(o_custkey % 100 AS DOUBLE)] AS v FROM orders"
PART_PLACE = "p_partkey AS cid, [p_retailprice / 10, CAST(p_size AS DOUBLE) * 2] AS c FROM part"


@query(f"""WITH o AS (SELECT {ORDER_PLACE}), p AS (SELECT {PART_PLACE}),
d AS (SELECT id, cid, (v[1] - c[1]) * (v[1] - c[1]) + (v[2] - c[2]) * (v[2] - c[2]) AS dist FROM o CROSS JOIN p)
SELECT id, unnest(s).cid AS cid, round(unnest(s).dist, 6) AS dist FROM (SELECT id, min({{'d': round(dist, 9), 'cid': cid, 'dist': dist}}, 2) AS s FROM d GROUP BY id)""")
def nn_grouped_index(spark, sf_dir):
    """The two nearest parts of every order in a plane, with the parts dealt to groups as if they were too many for a task."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array((F.col("o_totalprice") / 1000).cast("double"), (F.col("o_custkey") % 100).cast("double")).alias("v"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cid"), F.array((F.col("p_retailprice") / 10).cast("double"), (F.col("p_size") * 2).cast("double")).alias("centre"))
    found = index.indexed_neighbours(orders, parts, "squared_euclid", 2, point_id="id", most_values=max(1000, parts.count() // 4), leaf=32)
    return found.select("id", "cid", F.round("dist", 6).alias("dist"))


@query(f"WITH {LONG}, {CENTRES}, {DISTANCES}, {RANKED} SELECT vec_id, CAST(rank AS INTEGER) AS rank, cid, round(dist, 6) AS dist FROM r WHERE rank <= 2")
def nn_two(spark, sf_dir):
    points = _points(spark, sf_dir)
    return assign.neighbours(points, _centres(points), k=2).withColumn("dist", F.round("dist", 6))


@query(f"WITH {LONG}, {CENTRES}, {DISTANCES}, {RANKED} SELECT vec_id, CAST(rank AS INTEGER) AS rank, cid, round(dist, 6) AS dist FROM r WHERE rank <= 3 AND dist < 0.95")
def nn_topk_radius(spark, sf_dir):
    points = _points(spark, sf_dir)
    return assign.neighbours(points, _centres(points), k=3, within=0.95).withColumn("dist", F.round("dist", 6))


@query(f"WITH {LONG}, {CENTRES}, {DISTANCES}, {RANKED} SELECT vec_id, CAST(cid // 2 AS BIGINT) AS label FROM r WHERE rank = 1")
def node_to_cluster(spark, sf_dir):
    points = _points(spark, sf_dir)
    mapping = spark.range(10).select(F.col("id").alias("node"), F.floor(F.col("id") / 2).alias("label"))
    return assign.mapped(assign.nearest(points, _centres(points)), mapping).select("vec_id", "label")


PAIRS = """e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.i, a.x, b.x AS y FROM e a JOIN e b ON a.i = b.i AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"""


def _pairs(spark, sf_dir, distance, prepare=lambda v: v) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100; they meet all others."""
    every = _points(spark, sf_dir).select("vec_id", prepare(F.col("v")).alias("v"))
    return assign.distances(every, every.where("vec_id % 100 = 0"), distance).withColumn("dist", F.round("dist", 6))


@query(f"WITH {PAIRS} SELECT a, b, round(sqrt(sum((x - y) * (x - y))), 6) AS dist FROM p GROUP BY a, b")
def dist_euclid(spark, sf_dir):
    return _pairs(spark, sf_dir, "euclidean")


@query(f"WITH {PAIRS} SELECT a, b, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS dist FROM p GROUP BY a, b")
def dist_cosine(spark, sf_dir):
    return _pairs(spark, sf_dir, "cosine")


@query(f"WITH {PAIRS} SELECT a, b, round(1 - corr(x, y), 6) AS dist FROM p GROUP BY a, b")
def dist_pearson(spark, sf_dir):
    return _pairs(spark, sf_dir, "pearson")


@query(f"WITH {PAIRS} SELECT a, b, round(1 - corr(x, y) + 0.2 * count(*) FILTER (i % 16 = 0 AND abs(x - y) > 0.2), 6) AS dist FROM p GROUP BY a, b")
def dist_pspearson(spark, sf_dir):
    return _pairs(spark, sf_dir, "pspearson")


@query(f"""WITH {PAIRS}, g AS (SELECT *, lead(x) OVER w - x AS gx, lead(y) OVER w - y AS gy FROM p WINDOW w AS (PARTITION BY a, b ORDER BY i))
SELECT a, b, round(1 - corr(x, y) + 0.2 * count(*) FILTER (i < 62 AND gx * gy < 0 AND abs(gx - gy) > 0.2), 6) AS dist FROM g GROUP BY a, b""")
def dist_gradpearson(spark, sf_dir):
    return _pairs(spark, sf_dir, "gradpearson")


@query(f"WITH {PAIRS} SELECT a, b, round(sum(CASE WHEN abs(x) + abs(y) = 0 THEN 0 ELSE (abs(x) - abs(y)) * (abs(x) - abs(y)) / (0.25 * (abs(x) + abs(y)) * (abs(x) + abs(y))) END), 6) AS dist FROM p GROUP BY a, b")
def dist_fractional(spark, sf_dir):
    return _pairs(spark, sf_dir, "fraceuclidean", lambda v: F.transform(v, F.abs))


@query(f"WITH {LONG} SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM e GROUP BY label, i")
def vec_mean_std(spark, sf_dir):
    rows = V.vector_stats(_points(spark, sf_dir), "v", DIM, ["label"])
    return rows.select("label", F.posexplode(F.arrays_zip("mean", "std")).alias("i", "s")).select("label", "i", F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std"))


@query(f"WITH {LONG}, s AS (SELECT i, avg(x) AS m, stddev_samp(x) AS s FROM e GROUP BY i) SELECT vec_id, round(sum((x - m) / s), 5) AS total, round(sum(((x - m) / s) * ((x - m) / s)), 5) AS square FROM e JOIN s USING (i) GROUP BY vec_id")
def zscore(spark, sf_dir):
    points = _points(spark, sf_dir)
    stats = V.vector_stats(points, "v", DIM).select("mean", "std")
    z = points.crossJoin(F.broadcast(stats)).select("vec_id", V.zscore("v", "mean", "std").alias("z"))
    return z.select("vec_id", F.round(V.total(F.col("z")), 5).alias("total"), F.round(V.dot(F.col("z"), F.col("z")), 5).alias("square"))


@query(f"WITH {LONG}, s AS (SELECT i, avg(x) AS m FROM e GROUP BY i) SELECT vec_id, round(sum((x - m) * (x - m)), 5) AS square FROM e JOIN s USING (i) GROUP BY vec_id")
def mean_centre(spark, sf_dir):
    points = _points(spark, sf_dir)
    stats = V.vector_stats(points, "v", DIM).select("mean")
    z = points.crossJoin(F.broadcast(stats)).select("vec_id", V.mean_centre("v", "mean").alias("z"))
    return z.select("vec_id", F.round(V.dot(F.col("z"), F.col("z")), 5).alias("square"))


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(ln(CASE WHEN l_quantity = 0 THEN 1e-6 ELSE l_quantity END) + ln(CASE WHEN l_extendedprice = 0 THEN 1e-6 ELSE l_extendedprice END) + ln(CASE WHEN l_discount = 0 THEN 1e-6 ELSE l_discount END) + ln(CASE WHEN l_tax = 0 THEN 1e-6 ELSE l_tax END), 5) AS total FROM lineitem")
def log_floor_train(spark, sf_dir):
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(V.total(V.log_floor_train("v")), 5).alias("total"))


@query("""WITH m AS (SELECT 0.9 * min(least(coalesce(nullif(l_quantity, 0), 1e300), coalesce(nullif(l_extendedprice, 0), 1e300), coalesce(nullif(l_discount, 0), 1e300), coalesce(nullif(l_tax, 0), 1e300))) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, round(ln(CASE WHEN l_quantity <= 0 THEN f ELSE l_quantity END) + ln(CASE WHEN l_extendedprice <= 0 THEN f ELSE l_extendedprice END) + ln(CASE WHEN l_discount <= 0 THEN f ELSE l_discount END) + ln(CASE WHEN l_tax <= 0 THEN f ELSE l_tax END), 5) AS total FROM lineitem, m""")
def log_floor_infer(spark, sf_dir):
    items = _items(spark, sf_dir)
    floor = V.least_nonzero(items, "v")
    return items.crossJoin(F.broadcast(floor)).select("l_orderkey", "l_linenumber", F.round(V.total(V.log_floor_infer("v", "floor")), 5).alias("total"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / (l_quantity + l_extendedprice + l_discount + l_tax), 6) AS share FROM lineitem")
def row_l1(spark, sf_dir):
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(F.get(V.row_l1("v"), F.lit(1)), 6).alias("share"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY event_type")
def partial_stats_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    merged = V.merge_stats(V.partial_stats(events, "value", ["event_type", "day"]), ["event_type"])
    return merged.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT round(min(l_extendedprice), 4) AS lo, round(max(l_extendedprice), 4) AS hi, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(0.9 * min(CASE WHEN l_discount <> 0 THEN l_discount END), 6) AS least FROM lineitem")
def feature_report(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    p = "l_extendedprice"
    return items.agg(*(F.round(f(p), 4).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"), (F.stddev_samp, "std"))), F.round(F.min(F.when(F.col("l_discount") != 0, F.col("l_discount"))) * 0.9, 6).alias("least"))


@query(f"""WITH {LONG}, {CENTRES}, {DISTANCES},
q AS (SELECT vec_id, cid, 1 - corr(e.x, c.x) + 0.2 * count(*) FILTER (i % 16 = 0 AND abs(e.x - c.x) > 0.2) AS dist FROM e JOIN c USING (i) GROUP BY ALL)
SELECT 'squared_euclid' AS metric, round(sum(m), 4) AS error FROM (SELECT min(dist) AS m FROM d GROUP BY vec_id)
UNION ALL SELECT 'pspearson', round(sum(m), 4) FROM (SELECT min(dist) AS m FROM q GROUP BY vec_id)""")
def quant_error(spark, sf_dir):
    points = _points(spark, sf_dir)
    return assign.quantisation_error(points, _centres(points), ["squared_euclid", "pspearson"]).withColumn("error", F.round("error", 4))


@query(f"""WITH {LONG}, {CENTRES},
q AS (SELECT vec_id, cid, 1 - sum(e.x * c.x) / (sqrt(sum(e.x * e.x)) * sqrt(sum(c.x * c.x))) AS dist FROM e JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, cid, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), cid) AS r FROM q) WHERE r = 1""")
def nearest_centroid(spark, sf_dir):
    points = _points(spark, sf_dir)
    return cluster.nearest_centroid(points, points, "label", "v", DIM, "vec_id").withColumn("dist", F.round("dist", 6))


@query(f"WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.x * b.x), 5) AS g FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def gram_matrix(spark, sf_dir):
    return assign.gram(_points(spark, sf_dir), "v", DIM).withColumn("g", F.round("g", 5))


@query()
def pca_variance(spark, sf_dir):
    shares, _ = assign.principal_axes(_points(spark, sf_dir), "v", DIM)
    return spark.createDataFrame([(i, float(int(s * 100) / 100)) for i, s in enumerate(shares)], "component int, share double")


@query(f"WITH {LONG}, t AS (SELECT i, x AS y FROM e WHERE vec_id = 7) SELECT vec_id, round(sqrt(sum((x - y) * (x - y))), 6) AS dist FROM e JOIN t USING (i) GROUP BY vec_id")
def vector_search(spark, sf_dir):
    return assign.similarity_search(_points(spark, sf_dir), 7).withColumn("dist", F.round("dist", 6))


@query("SELECT DISTINCT round(l_discount, 1) AS d, round(l_tax, 1) AS t FROM lineitem")
def dedupe_rounded(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_discount", "l_tax").alias("v"))
    return catalog.distinct_rounded(rows, "v", 1).select(F.get("v", F.lit(0)).alias("d"), F.get("v", F.lit(1)).alias("t"))


# --- histograms of event types by user --------------------------------------------

TYPES = "ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events))"
HIST = f"{TYPES}, h AS (SELECT u.user_id, ty.k, count(ev.event_id) AS c FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN ty LEFT JOIN events ev ON ev.user_id = u.user_id AND ev.event_type = ty.event_type GROUP BY ALL)"
TFIDF = f"{HIST}, f AS (SELECT k, ln((1 + count(*)) / (1 + count(*) FILTER (c > 0))) + 1 AS idf FROM h GROUP BY k), w AS (SELECT user_id, k, c * idf AS w FROM h JOIN f USING (k)), t AS (SELECT user_id, k, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS w FROM w)"


def _histograms(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    types = sorted(r[0] for r in events.select("event_type").distinct().collect())  # a handful of types
    code = F.array_position(F.array(*map(F.lit, types)), F.col("event_type")) - 1
    return weight.histogram(events.select("user_id", code.alias("k")), "user_id", "k", len(types))


@query(f"WITH {HIST} SELECT user_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY k) AS counts FROM h GROUP BY user_id")
def label_histogram(spark, sf_dir):
    return _histograms(spark, sf_dir).select("user_id", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))


@query(f"WITH {HIST} SELECT user_id FROM h GROUP BY user_id HAVING sum(c) > 65")
def histogram_mass(spark, sf_dir):
    return weight.enough_mass(_histograms(spark, sf_dir), 65).select("user_id")


@query(f"WITH {TFIDF} SELECT user_id, k, round(w, 6) AS w FROM t")
def tfidf(spark, sf_dir):
    w = weight.tf_idf(_histograms(spark, sf_dir), "user_id")
    return w.select("user_id", F.posexplode("w").alias("k", "w")).select("user_id", F.col("k").cast("long").alias("k"), F.round("w", 6).alias("w"))


SEARCH = f"{TFIDF}, l AS (SELECT user_id, k, w / sum(w) OVER (PARTITION BY user_id) AS w FROM t), s AS (SELECT a.user_id, sqrt(sum((a.w - b.w) * (a.w - b.w))) AS dist FROM l a JOIN l b ON a.k = b.k AND b.user_id = 1 AND a.k > 0 GROUP BY a.user_id)"


def _search(spark, sf_dir) -> DataFrame:
    rows = weight.tf_idf(_histograms(spark, sf_dir), "user_id").select("user_id", F.slice(V.row_l1("w"), 2, 1000).alias("v"))
    return assign.similarity_search(rows, 1, point_id="user_id")


@query(f"WITH {SEARCH} SELECT user_id, round(dist, 6) AS dist FROM s")
def similarity_search(spark, sf_dir):
    return _search(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query(f"WITH {SEARCH}, o AS (SELECT user_id, row_number() OVER (ORDER BY round(dist, 9), user_id) - 1 AS rank, count(*) OVER () AS n FROM s) SELECT user_id, rank FROM o WHERE rank IN (SELECT (i * (n // 2)) // 24 FROM range(25) t(i), (SELECT count(*) AS n FROM s))")
def rank_sample(spark, sf_dir):
    rows = _search(spark, sf_dir).withColumn("d", F.round("dist", 9))
    return catalog.rank_sample(rows, ["d", "user_id"]).select("user_id", F.col("rank").cast("long").alias("rank"))


# --- clusterings of customers in the plane ------------------------------------------

PLANE = "p AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) / 2 AS y FROM customer)"


def _plane(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double") / 2).alias("v"))


def _lloyd(k: int, rounds: int) -> str:
    parts = [PLANE, f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x, y FROM p ORDER BY id LIMIT {k})"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT id, px, py, cid, dist FROM (SELECT p.id, p.x AS px, p.y AS py, cid, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) AS dist, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), cid) AS r FROM p CROSS JOIN c{r} c) WHERE r = 1)")
        parts.append(f"c{r + 1} AS (SELECT c.cid, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN (SELECT cid, avg(px) AS x, avg(py) AS y FROM a{r} GROUP BY cid) m USING (cid))")
    return f"WITH {', '.join(parts)} SELECT id, cid, round(dist, 6) AS dist FROM a{rounds}"


@query(_lloyd(5, 4))
def kmeans_lloyd(spark, sf_dir):
    return cluster.kmeans(_plane(spark, sf_dir), 5, 4, "id", "v", 2).withColumn("dist", F.round("dist", 6))


@query(f"""WITH {PLANE}, l AS (SELECT *, id % 4 AS label FROM p),
d AS (SELECT a.id, a.label, b.label AS other, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM l a JOIN l b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT id, label, min(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM d GROUP BY ALL)
SELECT id, label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM s""")
def silhouette(spark, sf_dir):
    points = _plane(spark, sf_dir).withColumn("label", F.col("id") % 4)
    return weight.silhouettes(points, "id", "v", "label").withColumn("silhouette", F.round("silhouette", 6))


@query(f"""WITH {PLANE}, l AS (SELECT *, id % 4 AS label FROM p),
d AS (SELECT a.id, a.label, b.label AS other, avg((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM l a JOIN l b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT id, label, min(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM d GROUP BY ALL)
SELECT id, label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM s""")
def silhouette_squared(spark, sf_dir):
    points = _plane(spark, sf_dir).withColumn("label", F.col("id") % 4)
    return weight.silhouettes(points, "id", "v", "label", "squared_euclid").withColumn("silhouette", F.round("silhouette", 6))


@query("SELECT c_custkey AS id, round(pow(greatest(2 - c_acctbal / 1000, c_acctbal / 1000 - 5, 0), 2) + pow(greatest(3 - c_nationkey / 2.0, c_nationkey / 2.0 - 7, 0), 2), 6) AS dist FROM customer")
def box_distance(spark, sf_dir):
    box = [F.array(F.lit(a), F.lit(b)) for a, b in ((2.0, 3.0), (5.0, 7.0))]
    return _plane(spark, sf_dir).select("id", F.round(V.rectangle_distance("v", *box), 6).alias("dist"))


@query(f"""WITH RECURSIVE {PLANE}, e AS (SELECT a.id AS s, b.id AS t FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.45),
c AS (SELECT s AS id FROM e GROUP BY s HAVING count(*) + 1 >= 5), ce AS (SELECT s, t FROM e WHERE s IN (FROM c) AND t IN (FROM c)),
r AS (SELECT id, id AS root FROM c UNION SELECT t, root FROM r JOIN ce ON s = id),
n AS (SELECT id, min(root) AS component FROM r GROUP BY id),
b AS (SELECT s AS id, min(component) AS near FROM e JOIN n ON n.id = e.t GROUP BY s)
SELECT p.id, coalesce(component, near, -1) AS cluster, component IS NOT NULL AS core FROM p LEFT JOIN n USING (id) LEFT JOIN b USING (id)""")
def dbscan(spark, sf_dir):
    return cluster.dbscan(_plane(spark, sf_dir), "id", "v", 0.45, 5)


# Customers as the leaves 0 to n - 1 of a tree: merge k joins what a heap has below place k, at the distance 1 / k.
TREE_SQL = """m AS (SELECT -c_custkey AS id, CASE WHEN 2 * c_custkey < n THEN -2 * c_custkey ELSE 2 * c_custkey - n END AS l,
CASE WHEN 2 * c_custkey + 1 < n THEN -2 * c_custkey - 1 ELSE 2 * c_custkey + 1 - n END AS r, CAST(1 AS DOUBLE) / c_custkey AS d FROM customer, (SELECT count(*) AS n FROM customer) WHERE c_custkey > 0 AND c_custkey < n)"""
LEVELS = [0.0005, 0.01, 0.3, 0.5, 2.0]
CUT = f"""{TREE_SQL}, th AS (SELECT unnest({LEVELS}) AS threshold),
f AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(-1 AS BIGINT) AS node, CASE WHEN 1.0 < threshold THEN CAST(-1 AS BIGINT) END AS root FROM th
 UNION ALL
 SELECT f.threshold, c.node, coalesce(f.root, CASE WHEN c.node >= 0 OR k.d < f.threshold THEN c.node END)
 FROM f JOIN m ON m.id = f.node CROSS JOIN LATERAL (SELECT unnest([m.l, m.r]) AS node) c LEFT JOIN m k ON k.id = c.node)"""


def _tree(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    n = F.lit(customers.count())
    child = lambda c: F.when(c < n, -c).otherwise(c - n)
    return customers.where((F.col("k") > 0) & (F.col("k") < n)).select((-F.col("k")).alias("id"), child(2 * F.col("k")).alias("left"), child(2 * F.col("k") + 1).alias("right"), (1 / F.col("k")).alias("distance"))


@query(f"WITH RECURSIVE {CUT} SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(node AS BIGINT) AS node, CAST(root AS BIGINT) AS root FROM f WHERE node >= 0")
def hac_cut(spark, sf_dir):
    return cluster.roots(_tree(spark, sf_dir), spark.createDataFrame([(t,) for t in LEVELS], "threshold double"))


@query(f"""WITH RECURSIVE {TREE_SQL}, u AS (SELECT id, l AS node, d FROM m UNION ALL SELECT id, r, d FROM m UNION ALL SELECT u.id, c.node, u.d + m.d FROM u JOIN m ON m.id = u.node CROSS JOIN LATERAL (SELECT unnest([m.l, m.r]) AS node) c)
SELECT id, count(*) AS height, round(max(d), 6) AS depth FROM u WHERE node >= 0 GROUP BY id""")
def tree_shape(spark, sf_dir):
    return cluster.tree_shape(_tree(spark, sf_dir)).withColumn("depth", F.round("depth", 6))


@query(f"WITH RECURSIVE {CUT.replace(str(LEVELS), 'list_transform(range(10), lambda k: CAST(1 AS DOUBLE) - k * CAST(0.1 AS DOUBLE))')}, n AS (SELECT threshold, root, count(*) AS c FROM f WHERE node >= 0 GROUP BY ALL) SELECT round(CAST(threshold AS DOUBLE), 4) AS threshold, count(*) AS n_clusters, max(c) AS largest, round(avg(c), 6) AS mean_size FROM n GROUP BY threshold")
def hac_sweep(spark, sf_dir):
    swept = cluster.sweep(_tree(spark, sf_dir), spark, 1.0, 0.1, 0.05)
    return swept.select(F.round("threshold", 4).alias("threshold"), "n_clusters", "largest", F.round("mean_size", 6).alias("mean_size"))


WALK = f"""{TREE_SQL}, w AS (
 SELECT CAST(-1 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, CAST([] AS INTEGER[]) AS path FROM m WHERE id = -1
 UNION ALL
 SELECT c.node, w.node, list_append(w.path, c.side) FROM w JOIN m ON m.id = w.node CROSS JOIN LATERAL (SELECT unnest([m.l, m.r]) AS node, unnest([0, 1]) AS side) c),
x AS (SELECT node AS leaf, node FROM w WHERE node >= 0 UNION ALL SELECT x.leaf, w.parent FROM x JOIN w ON w.node = x.node WHERE w.parent IS NOT NULL)"""


@query(f"""WITH RECURSIVE {WALK}, s AS (SELECT node, count(*) AS leaves FROM x GROUP BY node)
SELECT CAST(-1 AS BIGINT) AS tree, row_number() OVER (ORDER BY path) - 1 AS place, w.node, parent, CAST(len(path) AS BIGINT) AS level, round(m.d, 9) AS distance, leaves FROM w JOIN s ON s.node = w.node LEFT JOIN m ON m.id = w.node""")
def tree_preorder(spark, sf_dir):
    return trees.preorder(_tree(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@query(f"WITH RECURSIVE {WALK} SELECT node, leaf FROM x WHERE node < 0")
def tree_leaves(spark, sf_dir):
    return trees.leaves_of(_tree(spark, sf_dir))


@query("SELECT l_linenumber AS option, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY abs(count(*) - 5000), 1 LIMIT 1")
def threshold_pick(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("option")).agg(F.count("*").alias("n"))
    return catalog.nearest_target(counts, "n", "option", 5000)


@query()
def hac_merges(spark, sf_dir):
    nodes = _points(spark, sf_dir).select(F.col("vec_id").alias("node"), "v")
    return cluster.hac(nodes, "v", distance="pspearson").select("id", "left", "right", F.round("distance", 6).alias("distance"), "size")


@query()
def linkage_merges(spark, sf_dir):
    """Average linkage of all vectors by cosine, in rounds of reciprocal neighbours."""
    nodes = _points(spark, sf_dir).select(F.col("vec_id").alias("node"), "v")
    return linkage.agglomerated(nodes, "v", distance="cosine", linkage="average").withColumn("distance", F.round("distance", 6))


@query(f"""WITH RECURSIVE v AS (SELECT s_suppkey AS id, [s_acctbal / 1000, CAST(s_nationkey AS DOUBLE)] AS v FROM supplier),
e AS (SELECT a.id AS s, b.id AS t, round(list_distance(a.v, b.v), 9) AS d FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT unnest({[0.3, 0.8, 1.5]}) AS threshold),
r AS (SELECT threshold, id, id AS root FROM v, k UNION SELECT r.threshold, e.t, r.root FROM r JOIN e ON e.s = r.id AND e.d < r.threshold),
c AS (SELECT threshold, id, min(root) AS root FROM r GROUP BY ALL)
SELECT CAST(threshold AS DOUBLE) AS threshold, id AS node, root AS first FROM c""")
def single_linkage_cut(spark, sf_dir):
    """Suppliers by their smallest connected one, as cuts of the tree of single linkage."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.array((F.col("s_acctbal") / 1000).cast("double"), F.col("s_nationkey").cast("double")).alias("v"))
    merges = linkage.agglomerated(suppliers, "v", linkage="single").checkpoint()
    cut = cluster.roots(merges, spark.createDataFrame([(t,) for t in (0.3, 0.8, 1.5)], "threshold double"))
    first = cut.groupBy("threshold", "root").agg(F.min("node").alias("first"))
    return cut.join(first, ["threshold", "root"]).select("threshold", "node", "first")


@query()
def gng_fit(spark, sf_dir):
    model = cluster.fit_gas(_points(spark, sf_dir), "v", "vec_id", cluster.Gas(max_nodes=50, every=20))
    return model.select("kind", "a", "b", "age", F.round("error", 6).alias("error"), "last")


@query()
def gng_components(spark, sf_dir):
    return cluster.gas_components(cluster.fit_gas(_points(spark, sf_dir), "v", "vec_id", cluster.Gas(max_nodes=50, every=20)).checkpoint())


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) + CAST(embedding[65 - i] AS DOUBLE)) / 2.0)), 5) AS mid, round(0.5 * pow(0.995, vec_id % 10 + 0.0), 6) AS err FROM embeddings")
def gas_formulas(spark, sf_dir):
    rows = _points(spark, sf_dir)
    return rows.select("vec_id", F.round(V.total(V.midpoint("v", F.reverse("v"))), 5).alias("mid"), F.round(V.decayed(F.lit(0.5), F.lit(0), F.col("vec_id") % 10 + 1), 6).alias("err"))
