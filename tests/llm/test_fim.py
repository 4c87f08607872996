"""Fill-in-the-middle against a plain list of units."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import fim
from tessera.llm.queries import QUERIES

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ODD = [None, "", " ", "abc", "<P>", "a<S>b", "x <M", "<<P>", "P", "PSM<>", "<a>S<M>", "é", "aéb", "🙂a🙂🙂", "\x00a\n\r\n", "a" * 5000, "漢字" * 3000, "ab 1" * 20000]


def plain_cut(doc_id, text):
    """By a list of all units."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    spm = h[3] % 100 < 20
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_every_rank_is_where_the_list_of_units_has_it():
    rng = random.Random(1)
    for text in [t or "" for t in ODD[:-3]] + ["".join(rng.choice("aZPSM<> .é🙂\n0") for _ in range(rng.randrange(30))) for _ in range(3000)]:
        units, found = UNITS.findall(text), fim.scan(text)
        assert found.n == len(units)
        assert [found.place(r) for r in range(found.n + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]
        assert found.has_sentinel == any(s in text for s in ("<P>", "<S>", "<M>"))


def test_events_are_sparse():
    assert len(fim.scan("漢字" * 3000).starts) == 2
    assert len(fim.scan("a" * 100_000 + "." * 100_000).starts) == 3


def test_transformation_equals_the_list_of_units_and_is_restored(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abP< >S.é\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "again"), (7, "again"), (-5, "below zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in ("n", "form", "output", "prefix_chars", "restored")))
    found = fim.transform(docs).withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted((plain_cut(*r) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["restored"]) for r in found), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}


def test_nothing_is_shuffled_and_nothing_comes_of_nothing(spark):
    none = fim.transform(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0
    assert "Exchange" not in none._jdf.queryExecution().executedPlan().toString()


def test_query_has_the_contract_columns(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_fill_in_middle"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*plain_cut(i, t)[:5], sha(plain_cut(i, t)[5]), sha(t or "")) for i, t in enumerate(ODD)]
    assert sorted(map(tuple, found.collect())) == want
