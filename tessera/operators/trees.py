"""Binary merge trees of any size as tables: roots, heights, depths, places and cuts, without a row that holds a tree.

A tree is its merges (id, left, right, distance); what is no id is a leaf.  There may be
several trees.  Everything comes from one table of the merges with their places (``walked``),
which *contraction* makes.  A step takes away every merge whose two sides have known
numbers of leaves, or, in chains, merges with one such side, no two of them neighbours, and
gives the merge below the sum of what lay between.  Each step takes a share of the
merges, so all steps together read a small multiple of them.  The last few are walked in one task;
then the steps are gone back, and every merge gets its place from its parent's.

* Downwards go first leaf place, preorder place, level, and the least and summed distance above.
* The leaves below a node are a range of places, as they follow one another.

A node is a cluster at a threshold if its own distance is below it and none above
is: that is a range of thresholds, so a sweep joins nothing, and a cut is a join
of blocks of leaf places with the ranges of its clusters.

Steps are written tables.  An empty table gives empty results; rows with a null id, left or right are no merges.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Tables

#: Leaf places of a block, which is one row with its leaves in order.
BLOCK = 256
#: Contraction ends when so many merges are left.
FEW = 4096
EDGE = "struct<up:long, more:long, first:long, place:long, level:long, least:double, summed:double>"
WALKED = "id long, tree long, parent long, first long, place long, level long, least double, summed double, distance double, left long, right long, nl long, nr long"


def _usable(merges: DataFrame) -> DataFrame:
    return merges.select(*(F.col(c).cast("long").alias(c) for c in ("id", "left", "right")), F.col("distance").cast("double").alias("distance")).where("id is not null and left is not null and right is not null")


def _begun(merges: DataFrame, tables: Tables) -> DataFrame:
    """(id, parent, side, distance, left, right, nl, nr, edge), a contraction's state: nl and nr are the leaves on each side, null where a merge is; no edge has taken anything in."""
    rows = _usable(merges)
    both = F.array(F.struct(F.col("left").alias("node"), F.lit(0).alias("side")), F.struct(F.col("right").alias("node"), F.lit(1).alias("side")))
    child = rows.select(F.col("id").alias("parent"), F.explode(both).alias("c")).select(F.col("c.node").alias("id"), "parent", "c.side")
    linked = tables.put(rows.join(child, "id", "left"), "linked")
    inner = linked.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.max(F.col("side") == 0).alias("_l"), F.max(F.col("side") == 1).alias("_r"))
    known = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit(None)).otherwise(1).cast("long")
    return linked.join(inner, "id", "left").select("id", "parent", "side", "distance", "left", "right", known(F.col("_l")).alias("nl"), known(F.col("_r")).alias("nr"), F.lit(None).cast(EDGE).alias("edge"))


#: Both sides are counted; one side is, and there is a parent.
READY = "nl is not null and nr is not null"
SINGLE = "(nl is null) <> (nr is null) and parent is not null and parent <> id"


def _edge(name: str) -> Column:
    """A sum of the way from a merge up to its present parent."""
    return F.coalesce(F.col(f"edge.{name}"), F.lit(0))


def _raked(state: DataFrame) -> DataFrame:
    """What is left without the merges whose leaves are counted; parents get the counts."""
    told = state.where(f"{READY} and parent is not null").select(F.col("parent").alias("id"), "side", (F.col("nl") + F.col("nr") + _edge("more")).alias("n"))
    told = told.groupBy("id").agg(*(F.max(F.when(F.col("side") == i, F.col("n"))).alias(f"_n{i}") for i in (0, 1)))
    return state.where(f"not ({READY})").join(told, "id", "left").withColumns({"nl": F.coalesce("nl", "_n0"), "nr": F.coalesce("nr", "_n1")}).drop("_n0", "_n1")


def _between(step: int) -> Column:
    """Merges with one uncounted side whose hash is the least among itself, its parent and that side: no two are neighbours."""
    h = lambda c: F.xxhash64(c, F.lit(step))
    below = F.when(F.col("nl").isNull(), F.col("left")).otherwise(F.col("right"))
    return F.coalesce(F.expr(SINGLE) & (h("id") < h("parent")) & (h("id") < h(below)), F.lit(False))


def _shortened(state: DataFrame, gone: Column) -> DataFrame:
    """What is left without such merges; the merge below and the parent get each other, and the edge what lay between."""
    out = state.where(gone)
    on_right, known = F.col("nr").isNull(), F.coalesce("nl", "nr")
    below = F.when(on_right, F.col("right")).otherwise(F.col("left"))
    to_parent = out.select(F.col("parent").alias("id"), "side", below.alias("c")).groupBy("id").agg(*(F.max(F.when(F.col("side") == i, F.col("c"))).alias(f"_c{i}") for i in (0, 1)))
    passed = F.when(on_right, known).otherwise(0)
    to_child = out.select(
        below.alias("id"), F.col("parent").alias("_parent"), F.col("side").alias("_side"), (_edge("more") + known).alias("_more"), (_edge("first") + passed).alias("_first"),
        (_edge("place") + 1 + F.when(on_right, 2 * known - 1).otherwise(0)).alias("_place"), (_edge("level") + 1).alias("_level"), F.least("edge.least", "distance").alias("_least"), (_edge("summed") + F.coalesce("distance", F.lit(0.0))).alias("_summed"),
    )
    met = state.where(~gone).join(to_parent, "id", "left").join(to_child, "id", "left")
    sums = [(F.col(f"_{n}") + _edge(n)).alias(n) for n in ("more", "first", "place", "level")]
    edge = F.struct(F.coalesce("edge.up", "parent").alias("up"), *sums, F.least("_least", "edge.least").alias("least"), (F.col("_summed") + _edge("summed")).alias("summed"))
    return met.select(
        "id", F.coalesce("_parent", "parent").alias("parent"), F.coalesce("_side", "side").alias("side"), "distance", F.coalesce("_c0", "left").alias("left"), F.coalesce("_c1", "right").alias("right"),
        "nl", "nr", F.when(F.col("_parent").isNotNull(), edge).otherwise(F.col("edge")).alias("edge"),
    )


def _less(a: float | None, b: float | None) -> float | None:
    """The smaller one as Spark's ``least``: nulls are skipped, NaN is the largest."""
    if a is None or b is None:
        return b if a is None else a
    return b if a != a or b < a else a


def _few(group: pa.Table) -> pa.Table:
    """WALKED of the merges that a contraction leaves, from the topmost downwards; what no way leads to has no row."""
    at = {r["id"]: r for r in group.to_pylist()}
    edge = lambda r, name: (r["edge"] or {}).get(name) or 0
    order = [r for r in at.values() if r["parent"] is None]
    for r in order:  # grows as it goes
        order += [at[r[c]] for c, n in (("left", "nl"), ("right", "nr")) if r[n] is None and r[c] in at]
    for r in reversed(order):
        if r["parent"] is not None:
            at[r["parent"]]["nr" if r["side"] else "nl"] = r["nl"] + r["nr"] + edge(r, "more")
    for r in order:
        p = at.get(r["parent"])
        if p is None:
            r |= {"tree": r["id"], "first": 0, "place": 0, "level": 0, "least": None, "summed": 0.0}
            continue
        r["tree"], r["level"], r["summed"] = p["tree"], p["level"] + 1 + edge(r, "level"), p["summed"] + (p["distance"] or 0.0) + edge(r, "summed")
        r["first"] = p["first"] + (p["nl"] if r["side"] else 0) + edge(r, "first")
        r["place"] = p["place"] + 1 + (2 * p["nl"] - 1 if r["side"] else 0) + edge(r, "place")
        r["least"] = _less(_less(p["least"], p["distance"]), (r["edge"] or {}).get("least"))
    kinds = [c.split() for c in WALKED.split(", ")]
    for r in order:
        r["parent"] = r["edge"]["up"] if r["edge"] else r["parent"]
    return pa.table([pa.array([r[c] for r in order], pa.int64() if kind == "long" else pa.float64()) for c, kind in kinds], [c for c, _ in kinds])


def _placed(gone: DataFrame, above: DataFrame) -> DataFrame:
    """WALKED of merges that a step took away, from their parents at that time."""
    names = ["id", "tree", "first", "place", "level", "least", "summed", "distance", "nl", "nr"]
    met = gone.where("parent is not null").join(above.select(*(F.col(c).alias("parent" if c == "id" else f"p_{c}") for c in names)), "parent")
    right = F.col("side") == 1
    total = F.when(right, F.col("p_nr")).otherwise(F.col("p_nl")) - _edge("more")
    below = met.select(
        "id", F.col("p_tree").alias("tree"), F.coalesce("edge.up", "parent").alias("parent"), (F.col("p_first") + F.when(right, F.col("p_nl")).otherwise(0) + _edge("first")).alias("first"),
        (F.col("p_place") + 1 + F.when(right, 2 * F.col("p_nl") - 1).otherwise(0) + _edge("place")).alias("place"), (F.col("p_level") + 1 + _edge("level")).alias("level"),
        F.least("p_least", "p_distance", "edge.least").alias("least"), (F.col("p_summed") + F.coalesce("p_distance", F.lit(0.0)) + _edge("summed")).alias("summed"),
        "distance", "left", "right", F.coalesce("nl", total - F.col("nr")).alias("nl"), F.coalesce("nr", total - F.col("nl")).alias("nr"),
    )
    none, zero = F.lit(None), F.lit(0).cast("long")
    tops = gone.where("parent is null").select("id", F.col("id").alias("tree"), none.cast("long").alias("parent"), zero.alias("first"), zero.alias("place"), zero.alias("level"), none.cast("double").alias("least"), F.lit(0.0).alias("summed"), "distance", "left", "right", "nl", "nr")
    return below.unionByName(tops)


def walked(merges: DataFrame, few: int | None = None) -> DataFrame:
    """WALKED: the merges with their tree (its topmost merge), parent, first leaf place and preorder place in it, level, least and summed distance above, and the leaves nl and nr on each side.

    A side with one leaf is that leaf; other values of ``left`` and ``right`` are not to be used, as chains were shortened.
    Merges that lead back to themselves are an error.
    """
    tables, few = Tables(merges.sparkSession, "walks"), FEW if few is None else few
    now, steps = tables.put(_begun(merges, tables), "0"), []
    while True:
        n, ready, single = now.agg(F.count("*"), F.count_if(F.expr(READY)), F.count_if(F.expr(SINGLE))).first()
        if n <= few:
            break
        if not ready and not single:
            raise ValueError("a merge leads back to itself")
        rake = 3 * ready >= single  # a third of a chain goes in a step
        gone = F.expr(READY) if rake else _between(len(steps))
        steps.append(now.where(gone))
        now = tables.put(_raked(now) if rake else _shortened(now, gone), str(len(steps)))
    done = tables.put(now.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(_few, WALKED), "walked")
    paths = [tables.paths["walked"]]
    if done.count() != n:
        raise ValueError("a merge leads back to itself")
    for i in reversed(range(len(steps))):
        tables.put(_placed(steps[i], done), f"walked {i}")
        paths.append(tables.paths[f"walked {i}"])
        done = merges.sparkSession.read.schema(WALKED).parquet(*paths)
    return done


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, tree, parent, is_leaf, leaves, first, place, level, least, summed, distance) of the merges of WALKED and of their leaves."""
    nl, one = F.col("nl"), F.lit(1).cast("long")
    under = [(F.col("level") + 1).alias("level"), F.least("least", "distance").alias("least"), (F.col("summed") + F.coalesce("distance", F.lit(0.0))).alias("summed"), F.lit(None).cast("double").alias("distance")]
    leaf = lambda c, first, place: F.struct(F.col(c).alias("node"), "tree", F.col("id").alias("parent"), F.lit(True).alias("is_leaf"), one.alias("leaves"), first.alias("first"), place.alias("place"), *under)
    own = F.struct(F.col("id").alias("node"), "tree", "parent", F.lit(False).alias("is_leaf"), (nl + F.col("nr")).alias("leaves"), "first", "place", "level", "least", "summed", "distance")
    left = F.when(nl == 1, leaf("left", F.col("first"), F.col("place") + 1))
    right = F.when(F.col("nr") == 1, leaf("right", F.col("first") + nl, F.col("place") + 2 * nl))
    return rows.select(F.explode(F.array_compact(F.array(own, left, right))).alias("x")).select("x.*")


def above(merges: DataFrame) -> DataFrame:
    """(node, tree, least, summed, level): of all nodes, the least and the summed distance of the merges above, and their number; a tree is its topmost merge."""
    return _nodes(walked(merges)).select("node", "tree", "least", "summed", "level")


def tour(merges: DataFrame) -> DataFrame:
    """(node, tree, is_leaf, leaves, first, place): leaves below a node, the first of their places from 0 in its tree, and the node's preorder place from 0.

    A leaf has itself as its one leaf, so ``first`` is its place among the leaves.
    """
    return _nodes(walked(merges)).select("node", "tree", "is_leaf", "leaves", "first", "place")


class Walks:
    """The places of a tree's merges, made once, when they are first asked for, as written tables.

    Whoever asks several things of one tree hands this to the functions below instead of the merges.
    """

    def __init__(self, merges: DataFrame, few: int | None = None):
        self.merges, self.few = merges, few

    @cached_property
    def nodes(self) -> DataFrame:
        return _nodes(walked(self.merges, self.few))


def _walks(tree: DataFrame | Walks) -> Walks:
    return tree if isinstance(tree, Walks) else Walks(tree)


def preorder(merges: DataFrame | Walks) -> DataFrame:
    """(tree, place, node, parent, level, distance, leaves): the dump of a tree, a node before its left and then its right part; leaves have no distance."""
    return _walks(merges).nodes.select("tree", "place", "node", "parent", "level", "distance", "leaves")


def _blocks(items: DataFrame, at: str, value: str | Column) -> DataFrame:
    """(tree, block, values): what lies at BLOCK places that follow one another, in order."""
    rows = items.select("tree", F.expr(f"{at} div {BLOCK}").alias("block"), F.struct(F.col(at).alias("at"), (F.col(value) if isinstance(value, str) else value).alias("value")).alias("x"))
    return rows.groupBy("tree", "block").agg(F.array_sort(F.collect_list("x"))["value"].alias("values"))


def _spread(ranges: DataFrame, leaves: DataFrame, *keep: str) -> DataFrame:
    """(keep..., leaf): a row for each leaf of a range (tree, first, leaves), from blocks of leaves; a wide range is dealt out by blocks."""
    begin, last = f"first div {BLOCK}", f"(first + leaves - 1) div {BLOCK}"
    pieces = ranges.select(*keep, "tree", "first", "leaves", F.explode(F.sequence(F.expr(begin), F.expr(last))).alias("block"))
    base = F.col("block") * BLOCK
    pieces = pieces.select(*keep, "tree", "block", F.greatest(F.col("first") - base, F.lit(0)).cast("int").alias("_from"), F.least(F.col("first") + F.col("leaves") - base, F.lit(BLOCK)).cast("int").alias("_to"))
    dealt = pieces.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree", "block")
    return dealt.join(_blocks(leaves, "first", "node"), ["tree", "block"]).select(*keep, F.explode(F.slice("values", F.col("_from") + 1, F.col("_to") - F.col("_from"))).alias("leaf"))


def leaves_of(merges: DataFrame | Walks) -> DataFrame:
    """(node, leaf): every merge with every leaf below it."""
    nodes = _walks(merges).nodes
    return _spread(nodes.where("not is_leaf"), nodes.where("is_leaf"), "node")


def clusters(merges: DataFrame | Walks) -> DataFrame:
    """(node, tree, is_leaf, first, leaves, low, high): a node is a cluster at thresholds above ``low`` up to ``high``; a leaf's low and what has nothing above it are open (null)."""
    rows = _walks(merges).nodes.select("node", "tree", "is_leaf", "first", "leaves", F.col("distance").alias("low"), F.col("least").alias("high"))
    kept = F.col("is_leaf") | F.col("high").isNull() | (F.col("low") < F.col("high"))
    return rows.where(kept)


def _at(threshold: Column) -> Column:
    return (F.col("is_leaf") | (F.col("low") < threshold)) & (F.col("high").isNull() | (threshold <= F.col("high")))


def cut(merges: DataFrame | Walks, thresholds: DataFrame) -> DataFrame:
    """(threshold, node, root) for each leaf: the topmost cluster above it whose own distance is under the threshold, else itself."""
    wanted = thresholds.select(F.col("threshold").cast("double").alias("threshold")).distinct()
    tree = _walks(merges)
    # leaves on their own are known at once; blocks of leaves meet each cluster's range
    met = clusters(tree).join(F.broadcast(wanted), _at(F.col("threshold")))  # thresholds are a caller's list
    alone = met.where("is_leaf").select("threshold", "node", F.col("node").alias("root"))
    of_clusters = _spread(met.where("not is_leaf").withColumnRenamed("node", "root"), tree.nodes.where("is_leaf"), "threshold", "root")
    return alone.unionByName(of_clusters.select("threshold", F.col("leaf").alias("node"), "root"))


def swept(merges: DataFrame | Walks, thresholds: DataFrame) -> DataFrame:
    """(threshold, n_clusters, largest, mean_size) of the cuts at thresholds, from the clusters' ranges alone."""
    wanted = thresholds.select(F.col("threshold").cast("double").alias("threshold")).distinct()
    met = clusters(merges).join(F.broadcast(wanted), _at(F.col("threshold")))
    return met.groupBy("threshold").agg(F.count("*").alias("n_clusters"), F.max("leaves").alias("largest"), F.avg("leaves").alias("mean_size"))


def deepest(merges: DataFrame | Walks) -> DataFrame:
    """(node, tree, leaves, leaf, level, distance): of each merge its leaf with the largest sum of distances above it, the first of equal ones.

    A range of leaf places is the end of one block, the beginning of another and whole
    blocks between them, whose best leaves are the places of the next level; so a level has two pieces of each range.
    """
    nodes = _walks(merges).nodes
    tables, inner = Tables(nodes.sparkSession, "deepest"), nodes.where("not is_leaf")
    level = nodes.where("is_leaf").select("tree", F.col("first").alias("at"), F.struct("summed", (-F.col("first")).alias("back"), F.col("node").alias("leaf")).alias("b"))
    asked = inner.select("node", "tree", F.col("first").alias("low"), (F.col("first") + F.col("leaves") - 1).alias("high"))
    piece = lambda block, begin, end: F.struct(block.alias("block"), begin.cast("int").alias("begin"), end.cast("int").alias("end"))
    a, z, last = F.expr(f"low div {BLOCK}"), F.expr(f"high div {BLOCK}"), F.lit(BLOCK - 1)
    own = F.array(piece(a, F.col("low") - a * BLOCK, F.col("high") - a * BLOCK))
    ends = F.array(piece(a, F.col("low") - a * BLOCK, last), piece(z, F.lit(0), F.col("high") - z * BLOCK))
    best = None
    while True:
        blocks = tables.put(_blocks(level, "at", "b"))
        pieces = asked.select("node", "tree", F.explode(F.when(a == z, own).otherwise(ends)).alias("p")).select("node", "tree", "p.*")
        found = pieces.join(blocks, ["tree", "block"]).select("node", F.array_max(F.slice("values", F.col("begin") + 1, F.col("end") - F.col("begin") + 1)).alias("b"))
        best = found if best is None else best.unionByName(found)
        asked = asked.where(z - a > 1).select("node", "tree", (a + 1).alias("low"), (z - 1).alias("high"))
        if not asked.limit(1).count():
            break
        level = blocks.select("tree", F.col("block").alias("at"), F.array_max("values").alias("b"))
    best = best.groupBy("node").agg(F.max("b")["leaf"].alias("leaf"))
    return inner.join(best, "node").select("node", "tree", "leaves", "leaf", "level", "distance")


def shape(merges: DataFrame | Walks) -> DataFrame:
    """(id, height, depth) of each merge: the number of its leaves, and the largest sum of distances from it down to a leaf.

    Merges with the same deepest leaf are one path; a task adds a path's distances from
    each of its merges downwards, in order, so equal paths have equal sums
    whatever hangs beside them.  A group is one path: numbers, as many as the tree is high.
    """
    rows = deepest(merges).select("leaf", "node", "level", "leaves", "distance")

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("level").to_numpy())
        d = group.column("distance").to_numpy()[order]
        sums = np.empty(len(d))
        for i in range(len(d)):
            sums[i] = np.add.accumulate(d[i:])[-1]
        return pa.table([group.column("node").take(pa.array(order)), group.column("leaves").take(pa.array(order)), pa.array(sums)], ["id", "height", "depth"])

    return rows.groupBy("leaf").applyInArrow(run, "id long, height long, depth double")
