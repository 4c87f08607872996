import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import assign, weight

A, B = [1.0, 2.0, 3.0, 5.0], [2.0, 1.0, 4.0, 4.0]


def value(spark, column):
    return spark.createDataFrame([(A, B)], "a array<double>, b array<double>").select(column.alias("x")).first()[0]


def test_metrics_equal_numpy(spark):
    a, b = np.array(A), np.array(B)
    r = np.corrcoef(a, b)[0, 1]
    assert value(spark, V.squared_euclid("a", "b")) == pytest.approx(((a - b) ** 2).sum())
    assert value(spark, V.cosine("a", "b")) == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert value(spark, V.pearson("a", "b")) == pytest.approx(1 - r)
    # two bands of two values: the first values differ by 1 in both
    assert value(spark, V.pspearson("a", "b", 2)) == pytest.approx(1 - r + 0.4)
    assert value(spark, V.fractional_euclid("a", "b")) == pytest.approx(((a - b) ** 2 / (0.25 * (a + b) ** 2)).sum())


def test_gradient_penalty_leaves_out_the_last_pair(spark):
    a, b = np.array(A), np.array(B)
    g, h = np.diff(a)[:-1], np.diff(b)[:-1]
    want = 1 - np.corrcoef(a, b)[0, 1] + 0.2 * ((g * h < 0) & (abs(g - h) > 0.2)).sum()
    assert value(spark, V.gradpearson("a", "b")) == pytest.approx(want)


def test_vectors_without_direction_have_no_distance(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0], [1.0, 2.0])], "z array<double>, c array<double>, v array<double>")
    assert row.select(V.cosine("z", "v"), V.pearson("c", "v")).first() == (None, None)


def test_unknown_metric_is_an_error():
    with pytest.raises(ValueError):
        V.metric("linear")


def test_transforms(spark):
    assert value(spark, V.row_l1("a")) == pytest.approx([x / 11 for x in A])
    assert value(spark, V.midpoint("a", "b")) == [1.5, 1.5, 3.5, 4.5]
    assert value(spark, V.log_floor_train(F.array(F.lit(0.0)))) == pytest.approx([np.log(1e-6)])
    assert value(spark, V.log_floor_infer(F.array(F.lit(-3.0)), 0.5)) == pytest.approx([np.log(0.5)])
    assert value(spark, V.zscore("a", "b", F.array(*map(F.lit, (0.0, 2.0, 1.0, 1.0))))) == [-1.0, 0.5, -1.0, 1.0]


def test_merged_statistics_equal_those_of_all(spark):
    rows = spark.createDataFrame([(i % 3, i % 7, float(i * i % 11)) for i in range(100)], "k int, part int, x double")
    merged = {r["k"]: r for r in V.merge_stats(V.partial_stats(rows, "x", ["k", "part"]), ["k"]).collect()}
    for r in rows.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect():
        assert merged[r["k"]]["mean"] == pytest.approx(r["m"]) and merged[r["k"]]["std"] == pytest.approx(r["s"])


@pytest.mark.parametrize("most", [2_000_000, 8])
@pytest.mark.parametrize("k", [1, 3])
def test_neighbours_in_one_or_many_blocks(spark, most, k):
    rng = np.random.default_rng(0)
    p, c = rng.normal(size=(20, 4)), rng.normal(size=(9, 4))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "vec_id long, v array<double>")
    centres = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cid long, centre array<double>")
    found = {(r["vec_id"], r["rank"]): r["cid"] for r in assign.neighbours(points, centres, k=k, most_values=most).collect()}
    want = ((p[:, None] - c) ** 2).sum(2).argsort(1)
    assert found == {(i, j + 1): want[i, j] for i in range(20) for j in range(k)}


def test_principal_axes(spark):
    x = np.random.default_rng(1).normal(size=(30, 3)) * [3, 1, 0.1]
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, v array<double>")
    shares, _ = assign.principal_axes(points, "v", 3)
    s = np.linalg.svd(x)[1] ** 2
    assert shares == pytest.approx(s / s.sum())


def test_tf_idf_rows_have_unit_length(spark):
    rows = spark.createDataFrame([(1, [3, 0, 1]), (2, [0, 0, 2]), (3, [0, 0, 0])], "id int, counts array<long>")
    w = {r["id"]: np.array(r["w"]) for r in weight.tf_idf(rows, "id").collect()}
    assert np.linalg.norm(w[1]) == pytest.approx(1) and np.linalg.norm(w[3]) == 0
    assert w[1][0] / w[1][2] == pytest.approx(3 * (np.log(4 / 2) + 1) / (np.log(4 / 3) + 1))
