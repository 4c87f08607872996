"""Toxicity: the decoder against all ways through its lattices, counts against plain ones, and held-out accuracy."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.queries import QUERIES

BAD = ["idiot", "stupid", "pathetic", "clown", "worthless"]
SOUND = ["the", "and", "ing", "re", "on", "st", "at", "er", "ha", "en", "ou", "ti"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SOUND) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def disguised(rng, word):
    way = rng.randrange(4)
    if way == 0:
        signs = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7"}
        return "".join(signs.get(c, c) if rng.random() < 0.7 else c for c in word)
    if way == 1:
        return " ".join(word)
    if way == 2:
        return rng.choice(".-_*").join(word)
    k = rng.randrange(len(word))
    return word[:k] + word[k] * 5 + word[k + 1 :]


def corpus(n=600, seed=1):
    """(id, text, toxic): toxic texts have plain bad words, and those whose id is 1 modulo 3 by crc32 only disguised ones."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words, toxic = prose(rng, rng.randrange(5, 80)).split(), int(rng.random() < 0.3)
        held = zlib.crc32(str(i).encode()) % 3 == 1
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            bad = rng.choice(BAD)
            words.insert(rng.randrange(len(words) + 1), disguised(rng, bad) if held else bad)
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def decoder():
    words = collections.Counter(w for _, t, _ in corpus() for w in toxicity.WORD.findall(t.lower()))
    return toxicity.Decoder(toxicity.LetterModel(toxicity._triples(words)))


def test_viterbi_takes_the_cheapest_of_all_ways(decoder):
    cost = np.array(decoder.cost).reshape(64, 64, 64)

    def price(letters, paid):
        total, x, y = paid, 0, 0
        for c in letters:
            z = toxicity._code(c)
            if z == 0:
                if y == 0:
                    return None
                total, x, y = total + cost[x, y, 0], 0, 0
            else:
                total, x, y = total + cost[x, y, z], y, z
        return total + (cost[x, y, 0] if y else 0)

    for chunk in ["1d10t", "i d i o t", "s.c.u", "$t00p", "cl0wnn", "ii--33", "a1!b"]:
        lattice = [toxicity.Decoder.options(c, len(list(run))) for c, run in itertools.groupby(chunk)]
        ways = []
        for way in itertools.product(*lattice):
            letters = "".join(w[0] for w in way)
            if (total := price(letters, sum(w[1] for w in way))) is not None:
                ways.append((total, letters))
        least = min(ways)[0]
        got = " ".join(decoder.decode(chunk))
        assert any(abs(total - least) < 1e-6 and " ".join(letters.split()) == got for total, letters in ways), chunk


def test_disguises_are_restored_and_plain_text_is_not_touched(decoder):
    for disguise, word in [("1d10t", "idiot"), ("$tup1d", "stupid"), ("p.a.t.h.e.t.i.c", "pathetic"), ("c l o w n", "clown"), ("worrrrthless", "worthless"), ("W0RTHLE$$", "worthless"), ("clown###!!", "clown"), ("id!ot", "idiot")]:
        assert decoder.restore(f"the {disguise} and") == f"the {word} and"
        assert word in decoder.words(f"the\n{disguise} and")
    text = "the hand reon\n\nstand on"
    assert decoder.restore(text) == text and decoder.words(text) == set(text.split())
    assert decoder.restore("") == "" and decoder.words("") == set() and decoder.words("12 !! 3.4") == set()


def test_long_chunks_and_texts_are_read_whole(decoder):
    chunk = "i.d.i.o.t.c.l.o.w.n." * 500
    assert len("".join(decoder.decode(chunk))) == 5000
    text = ("the " * 300_000) + "cl0wn"
    assert decoder.words(text) == {"the", "clown", "cl", "wn"}
    assert "".join(toxicity.stretches(text)) == text


def test_triples_equal_plain_counts():
    words = collections.Counter({"the": 3, "a": 2, "née": 1, "ßy": 4})
    want = collections.Counter()
    for w, n in words.items():
        codes = [0, 0, *map(toxicity._code, w), 0]
        for g in zip(codes, codes[1:], codes[2:]):
            want[g] += n
    got = toxicity._triples(words).reshape(64, 64, 64)
    got[:, 0, 0] = 0  # between words, which aren't asked for
    assert {g: got[g] for g in map(tuple, np.argwhere(got).tolist())} == want


def test_letter_counts_cover_all_texts(spark):
    rows = corpus(90)
    found = toxicity.letter_counts(spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, None)], "doc_id long, text string").repartition(5))
    words = collections.Counter(w for _, t, _ in rows for w in toxicity.WORD.findall(t.lower()))
    assert found.sum() > 0
    grams = found.reshape(64, 64, 64)
    plain = toxicity._triples(words).reshape(64, 64, 64)
    plain[:, 0, 0] = grams[:, 0, 0] = 0  # between words, which aren't asked for
    assert (grams == plain).all()


def test_toxicity_of_held_out_disguises(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "x"), (3, rows[3][1])], "doc_id long, text string")
    frame = frame.select("*", *(F.lit("clash").alias(c) for c in ("toxic", "own", "score", "lang", "words")))
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 4] + [(7, None), (None, 1), (1, rows[1][2])], "doc_id long, toxic int")
    found = toxicity.classify(frame, labels).collect()
    assert len(found) == len(rows) + 4
    of = {r["doc_id"]: r for r in found}
    held = [(of[i], x) for i, _, x in rows if of[i]["held_out"]]
    assert len(held) > 150 and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert np.mean([r["predicted"] for r, x in held if x]) > 0.9
    assert np.mean([r["predicted"] for r, x in held if not x]) < 0.01
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 3}) == 1 and of[900]["score"] == of[901]["score"] < 0.3
    again = [tuple(r) for r in toxicity.classify(frame.repartition(3), labels).collect()]
    assert sorted(again, key=str) == sorted(map(tuple, found), key=str)


def test_toxicity_without_labels_or_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a clown"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.classify(docs, labels).collect()} == {0.5}
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = QUERIES["op12_toxicity"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 0


def test_restored_texts_of_a_table(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(120)] + [(500, "a 1d10t"), (501, None)], "doc_id long, text string")
    model = toxicity.Model(toxicity.Decoder(toxicity.LetterModel(toxicity.letter_counts(docs))), {}, 0.0)
    found = {r["doc_id"]: r["restored"] for r in toxicity.restored(docs, model).collect()}
    assert found[500] == "a idiot" and found[501] is None
    plain = [(i, t) for i, t, x in corpus(120) if not x]
    assert all(found[i] == t for i, t in plain if not re.search(r"(.)\1\1", t))


def test_regression_weighs_what_tells_toxic_from_other():
    rows = [np.array(r, np.int64) for r in [[0], [0, 1], [1], [], [2], [2, 1], [1], []] * 30]
    toxic = np.array([1, 1, 0, 0, 1, 1, 0, 0] * 30, float)
    w, b = toxicity.regress(rows, toxic, np.ones(len(rows)), 3)
    assert w[0] > 3 and w[2] > 3 and w[1] < 0.5 and (w >= 0).all() and b < -2
