"""How the quality classifier draws what it learns from."""

import random

from pyspark.sql import functions as F

from tessera.llm import common, pulearn


def test_texts_are_read_where_they_lie_when_positives_are_rare(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(20))) for i in range(2000)], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 2000, 66)] + [(1, 0)], "doc_id long, quality int")
    training = F.coalesce(common.remainder("doc_id", 5) != 0, F.lit(True))
    rows = pulearn.drawn(docs.where("doc_id >= 0"), labels, training, 300)
    plan = rows._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
    found = rows.collect()
    positives = {r["doc_id"] for r in found if r["positive"]}
    assert positives == {i for i in range(0, 2000, 66) if common.crc(str(i).encode()) % 5 != 0}
    assert 150 < sum(r["unlabelled"] for r in found) < 500
    # the exchange of the repartition above is the table's own; none behind it carries a text
    above = [line for line in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line and "RoundRobin" not in line and "REPARTITION" not in line]
    assert above and not any("text" in line for line in above) and "BroadcastHashJoin" in plan


def test_odd_labels_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(50)] + [(3, "a b 3"), (3, "other"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, float("nan")), (2, -1.0), (3, 1.0), (4, 1.0), (4, 0.0), (5, None), (None, 1.0), (6, 2.0)], "doc_id long, quality double")
    found = pulearn.drawn(docs, labels, F.lit(True), 1000).collect()
    assert sorted(r["doc_id"] for r in found if r["positive"]) == [3, 3, 6]
    assert len(found) == 51 and all(r["unlabelled"] for r in found)
