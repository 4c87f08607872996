"""Histograms, term weights and silhouettes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import NUMPY, between
from ..functions.vectors import finite, row_l2, squared_euclid, total
from .farfield import distance_sums
from .graph import ensure_checkpoint_dir


def _dense(entries: Column, labels: Column) -> Column:
    """Entries (i, n) as an array of n by i, from 0 to ``labels`` - 1, zero where there is none; in time of a sort."""
    every = F.when(labels > 0, F.sequence(F.lit(0), labels - 1)).otherwise(F.array().cast("array<int>"))
    zeros = F.transform(F.array_except(every, F.transform(entries, lambda e: e["i"])), lambda i: F.struct(i.alias("i"), F.lit(0).cast("long").alias("n")))
    return F.transform(F.array_sort(F.concat(entries, zeros)), lambda e: e["n"])


def histogram(rows: DataFrame, key: str, label: str, labels: int) -> DataFrame:
    """(key, counts): how often each label 0..labels-1 occurs, as one array; other labels count for nothing.

    Counts by key and label combine before the shuffle; then a key has ``labels`` rows at most.
    """
    counted = rows.groupBy(F.col(key).alias("_k"), F.when(F.col(label).between(0, labels - 1), F.col(label)).cast("int").alias("_l")).agg(F.count("*").alias("_n"))
    held = F.collect_list(F.when(F.col("_l").isNotNull(), F.struct(F.col("_l").alias("i"), F.col("_n").alias("n"))))
    return counted.groupBy("_k").agg(held.alias("_e")).select(F.col("_k").alias(key), _dense(F.col("_e"), F.lit(labels)).alias("counts"))


def enough_mass(hists: DataFrame, least: int, skip: int = 0, whole: bool = True) -> DataFrame:
    """Rows whose counts add up to more than ``least``; without ``whole`` the last ``skip`` columns don't count, as older files have it."""
    size = F.size("counts") - skip - (0 if whole else skip)
    mass = F.aggregate(F.slice("counts", skip + 1, F.greatest(size, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return hists.where(mass > least)


def tf_idf(hists: DataFrame, key: str) -> DataFrame:
    """(key, w): counts times ln((1 + n) / (1 + df)) + 1, each row of unit length.

    n and all df come of one aggregate, in which a row counts once for itself (at -1) and once for each label that it has.
    """
    places = F.filter(F.transform("counts", lambda c, i: F.when(c > 0, i)), lambda i: i.isNotNull())
    counted = hists.select(F.explode(F.concat(F.array(F.lit(-1)), F.coalesce(places, F.array().cast("array<int>")))).alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    size = hists.agg(F.coalesce(F.max(F.size("counts")), F.lit(0)).alias("labels"))
    held = counted.agg(F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "n"))).alias("e"), F.coalesce(F.max(F.when(F.col("i") < 0, F.col("n"))), F.lit(0)).alias("rows"))  # a row for each label
    one = held.crossJoin(size).select(F.transform(_dense(F.col("e"), F.col("labels")), lambda df: F.ln((1 + F.col("rows")) / (1 + df)) + 1).alias("idf"))
    raw = hists.crossJoin(F.broadcast(one)).select(key, F.zip_with("counts", F.slice("idf", 1, F.greatest(F.size("counts"), F.lit(0))), lambda c, w: c * w).alias("w"))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x))
    return raw.select(key, "w", norm.alias("norm")).select(key, F.when(F.col("norm") == 0, F.col("w")).otherwise(F.transform("w", lambda x: x / F.col("norm"))).alias("w"))


def _worth(a: Column, b: Column) -> Column:
    """(b - a) / max(a, b); 0 without one of them."""
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)))


def silhouettes(points: DataFrame, point_id: str, v: str, label: str, distance: str = "euclidean", block: int = 2000) -> DataFrame:
    """(point_id, label, silhouette): (b - a) / max(a, b); 0 for a point alone in its cluster.

    The mean squared Euclidean or cosine distance to a cluster follows from the
    cluster's mean and variance, so these take one pass over the points.  Other
    metrics need every pair of places: points with equal vectors are one place with
    counts by label.  Many places in the line or the plane have their Euclidean distances added up by
    ``farfield``.  Else places are dealt to blocks, a task takes a block against
    another and returns sums of distances by place and label, and the
    work grows with the square of the places, not of the points.  Pairs without a distance, as of
    vectors without a direction, are left out; so are rows without a label.
    Vectors that hold a null, NaN or infinity have no distances.  A repeated
    row is another point.
    """
    if distance in ("squared_euclid", "cosine"):
        return _silhouettes_by_sums(points, point_id, v, label, distance)
    if distance not in NUMPY:
        raise ValueError(f"no numpy form of {distance!r}")
    every = points.select(F.col(point_id).alias("_id"), F.transform(F.col(v).cast("array<double>"), lambda x: x + 0.0).alias("_v"), F.col(label).alias("_l")).withColumn("_key", F.xxhash64("_v"))
    kinds = dict(points.dtypes)
    usable = every.where(finite("_v") & F.col("_l").isNotNull())
    held = usable.groupBy("_key", "_v", "_l").agg(F.count("*").alias("n")).groupBy("_key", "_v").agg(F.collect_list(F.struct(F.col("_l").alias("l"), "n")).alias("_held"))
    places = held.count()
    sums = _sums_in_the_plane(held, kinds[label]) if distance == "euclidean" and places > PLANE_PLACES else None
    if sums is None:
        sums = _sums_by_blocks(held, places, distance, block, kinds[label])
    # the point itself is no other; its place has a distance to its label where it has one to itself
    met = usable.select("_key", "_l").distinct().join(sums, "_key")
    ab = met.groupBy("_key", "_l").agg(F.min(F.when((F.col("other") == F.col("_l")) & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(F.col("other") != F.col("_l"), F.col("s") / F.col("n"))).alias("b"))
    found = every.join(ab, ["_key", "_l"], "left")
    return found.select(F.col("_id").alias(point_id), F.col("_l").alias(label), _worth(F.col("a"), F.col("b")).alias("silhouette"))


#: Places above which distances in the line and the plane aren't taken pair by pair, and labels up to which.
PLANE_PLACES, PLANE_LABELS = 20_000, 32


def _sums_in_the_plane(held: DataFrame, kind: str) -> DataFrame | None:
    """(_key, other, n, s) by ``farfield``, for vectors of one or two components and few labels; else nothing."""
    ensure_checkpoint_dir(held.sparkSession)
    at = [F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0)) for i in range(2)]
    box = held.agg(F.min(F.size("_v")), F.max(F.size("_v")), F.min(at[0]), F.max(at[0]), F.min(at[1]), F.max(at[1])).first()
    side = max(box[3] - box[2], box[5] - box[4])
    if box[0] != box[1] or not 1 <= box[0] <= 2 or not 0 < side < 1e150:
        return None
    totals = held.select(F.explode("_held").alias("h")).groupBy(F.col("h.l").alias("l")).agg(F.sum("h.n").alias("n")).limit(PLANE_LABELS + 1).collect()
    if len(totals) > PLANE_LABELS or kind.startswith(("float", "double", "map", "struct", "array")):
        return None
    names = F.array(*(F.lit(r["l"]).cast(kind) for r in totals))
    copies = lambda name: F.aggregate(F.filter("_held", lambda h: h["l"] == name), F.lit(0.0), lambda s, h: s + h["n"])
    places = held.select("_key", at[0].alias("x"), at[1].alias("y"), F.transform(names, copies).alias("w"))
    sums = distance_sums(places, len(totals), (box[2], box[4]), side * (1 + 1e-9))
    each = sums.select("_key", F.posexplode(F.arrays_zip(names.alias("other"), F.array(*(F.lit(r["n"]).cast("long") for r in totals)).alias("n"), F.col("sums").alias("s"))))
    return each.select("_key", F.col("col.other").alias("other"), F.col("col.n").alias("n"), F.col("col.s").alias("s"))


def _sums_by_blocks(held: DataFrame, places: int, distance: str, block: int, kind: str) -> DataFrame:
    """(_key, other, n, s): for each place and label the number of points with a distance, and the distances' sum."""
    blocks = max(1, -(-places // min(max(block, places // 24), 10 * block)))
    own = F.pmod("_key", F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("_own", o).alias("i"), F.greatest("_own", o).alias("j")))
    dealt = held.withColumn("_own", own).withColumn("_p", F.explode(pairs)).select(F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"), "_own", "_key", "_v", "_held")

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
        key, own = (group.column(c).to_numpy() for c in ("_key", "_own"))
        x = group.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(key), -1)
        held = group.column("_held").combine_chunks()
        labels = held.flatten().field("l").dictionary_encode()
        names = labels.dictionary
        member = np.zeros((len(key), len(names)))  # copies of each place with each label
        member[np.repeat(np.arange(len(key)), held.value_lengths().to_numpy()), labels.indices.to_numpy()] = held.flatten().field("n").to_numpy()
        mine, others = np.flatnonzero(own == i), np.flatnonzero(own == j)
        n, sums = np.zeros(member.shape), np.zeros(member.shape)
        share = max(1, (1 << 17) // max(1, len(others)))
        for begin in range(0, len(mine), share):
            at = mine[begin : begin + share]
            d = between(distance, x[at], x[others])
            if i == j:  # copies have no distance, rounding apart
                same = d[np.arange(len(at)), begin + np.arange(len(at))]
                d[np.arange(len(at)), begin + np.arange(len(at))] = np.where(np.isnan(same), np.nan, 0.0)
            known = ~np.isnan(d)
            d = d if known.all() else np.where(known, d, 0.0)
            for one, two, weights, ns in ((at, d, member[others], known), (others, d.T, member[at], known.T))[: 1 if i == j else 2]:
                sums[one] += two @ weights
                n[one] += weights.sum(0) if known.all() else ns @ weights
        row, other = np.nonzero(n > 0)
        return pa.table([pa.array(key[row]), names.take(pa.array(other)), pa.array(n[row, other].astype(np.int64)), pa.array(sums[row, other])], ["_key", "other", "n", "s"])

    return dealt.groupBy("_i", "_j").applyInArrow(run, f"_key long, other {kind}, n long, s double").groupBy("_key", "other").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _silhouettes_by_sums(points: DataFrame, point_id: str, v: str, label: str, distance: str, most_values: int = 2_000_000) -> DataFrame:
    """Mean squared distance to a cluster: |x - mean|^2 and the cluster's variance, which don't cancel; cosine is half of it on unit vectors.

    Clusters travel in blocks of a bounded size, and the blocks' answers are merged.
    """
    w = F.col(v) if distance == "squared_euclid" else row_l2(v)
    rows = points.select(F.col(point_id), F.col(label), w.alias("_w"))
    dim = points.agg(F.max(F.size(v))).first()[0] or 0
    usable = rows.where(F.col(label).isNotNull() & finite("_w") & (F.size("_w") == dim))
    at = lambda f: F.array(*(f(F.get("_w", F.lit(i))) for i in range(dim)))
    stats = usable.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n"), at(F.avg).alias("m"), total(at(F.var_pop)).alias("q"))
    blocks = max(1, -(-stats.count() * max(1, dim) // most_values))
    packed = stats.groupBy(F.pmod(F.xxhash64("l"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("l", "n", "m", "q")).alias("clusters")).drop("_b")
    met = rows.crossJoin(F.broadcast(packed) if blocks == 1 else packed)
    mean = lambda c: squared_euclid(F.col("_w"), c["m"]) + c["q"]  # noqa: E731  of squared distances to a cluster's points
    half = 1.0 if distance == "squared_euclid" else 0.5
    own = F.get(F.filter("clusters", lambda c: c["l"] == F.col(label)), F.lit(0))
    others = F.array_min(F.transform(F.filter("clusters", lambda c: c["l"] != F.col(label)), lambda c: mean(c) * half))
    a = F.when(own["n"] > 1, mean(own) * own["n"] / (own["n"] - 1) * half)  # the point itself is no other
    usable_here = finite("_w") & (F.size("_w") == dim)
    found = met.select(point_id, label, "_w", F.when(usable_here, a).alias("_a"), F.when(usable_here, others).alias("_b"))
    if blocks > 1:
        found = found.groupBy(point_id, label, "_w").agg(F.max("_a").alias("_a"), F.min("_b").alias("_b"))
        found = rows.alias("p").join(found.alias("q"), F.col(f"p.{point_id}").eqNullSafe(F.col(f"q.{point_id}")) & F.col(f"p.{label}").eqNullSafe(F.col(f"q.{label}")) & F.col("p._w").eqNullSafe(F.col("q._w"))).select(F.col(f"p.{point_id}"), F.col(f"p.{label}"), "_a", "_b")
    return found.select(point_id, label, _worth(F.col("_a"), F.col("_b")).alias("silhouette"))
