"""Operators for training data against brute force, exact round trips and held-out accuracy."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, jaccard, langid, licences, lm, packing, pulearn, rpforest, rules, tokenfile, vocab

WORDS = [a + b for a in ("st", "on", "the", "re", "qu", "éa", "ß") for b in ("an", "er", "ing", "o", "ux", "")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed=0, n=60):
    """Clean texts, copies, near copies, and every odd case."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randrange(20, 120)) for _ in range(n)]
    for i in range(0, n, 6):
        words = out[i].split()
        words[len(words) // 2] = "changed"
        out += [out[i], " ".join(words), out[i].upper()]
    out += [None, "", " \n\t", "one", "one two", "One\x0bTWO", "a b c d e", "# $ %", "12 345", "x" * 9000, "<|endoftext|> a <|startoftext|>", "漢字 かな 🙂 é é ΣΑΣ İ", "a\nb\n\nb\n b \nb", "\x00 \x1c end"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts())]
    found = spark.createDataFrame(rows + [(None, "no id here", None, None, None), (3, rows[3][1], "en", "s", 1)], DOCS)
    # columns with the names that operators use inside
    names = "key block train part label rank mark positive bucket kind target n group a b size ids text_key open task".split()
    return found.select("*", *(F.lit("clash").alias(n) for n in names))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# --- op1 ------------------------------------------------------------------------------


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_jaccard(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), i if not s else least.get(find(k))) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("options", [{}, {"hot": 2, "block": 3}])
def test_jaccard_equals_brute_force(docs, options):
    found = [tuple(r) for r in jaccard.Join(**options).components(docs).collect()]
    assert sorted(found, key=str) == brute_jaccard(pairs_of(docs))


def test_jaccard_of_one_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = prose(rng, 60).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.Join(hot=10, block=20).components(frame).collect()), key=str) == brute_jaccard(rows)


def test_jaccard_of_nothing(spark):
    assert jaccard.components(empty(spark)).count() == 0


def test_divide_skip_equals_counting():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randrange(1, 12))) for _ in range(rng.randrange(1, 20))]
        t = rng.randrange(1, 12)
        counts = collections.Counter(x for own in lists for x in own)
        assert jaccard.divide_skip(lists, t) == {x: c for x, c in counts.items() if c >= t}


def test_word_hashes_follow_the_word_rule():
    rng = random.Random(3)
    for _ in range(500):
        raw = "".join(rng.choice("aAbBé \t\n\r\x0b\x0c漢") for _ in range(rng.randrange(30))).encode()
        words, hashes = common.words_of(raw), common.word_hashes(raw).tolist()
        assert len(words) == len(hashes) and len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))


# --- op2 ------------------------------------------------------------------------------


def test_licence_scan_skips_nothing_that_reaches_the_threshold(spark):
    rng = random.Random(4)
    notes = list(licences.TEMPLATES.values())
    rows = [(i, "a/b/x", True, "\n".join(rng.choice([prose(rng, 9), rng.choice(notes), " ".join(rng.choices(rng.choice(notes).split(), k=4))]) for _ in range(rng.randrange(1, 9)))) for i in range(80)] + [(80, None, None, None), (81, "x", False, "")]
    frame = spark.createDataFrame(rows, "doc_id long, path string, is_file boolean, text string")
    found = {r["doc_id"]: r for r in licences.scan(frame).collect()}
    df = collections.Counter(t for _, _, _, text in rows for t in set(licences.terms((text or "").encode())))
    idf = lambda t: np.log((1 + len(rows)) / (1 + (df[t] if t in known else 0))) + 1
    split = {k: collections.Counter(licences.terms(t.encode())) for k, t in licences.TEMPLATES.items()}
    known = set().union(*split.values())
    norm = lambda c: sum((n * idf(t)) ** 2 for t, n in c.items()) ** 0.5
    for i, _, _, text in rows:
        lines, best, name = (text or "").split("\n"), 0.0, None
        for a in range(len(lines)):
            for n in range(1, 4):
                own = collections.Counter(licences.terms("\n".join(lines[a : a + n]).encode()))
                for k, t in split.items():
                    if own and (c := sum(own[x] * t[x] * idf(x) ** 2 for x in own) / norm(own) / norm(t)) > best + 1e-9:
                        best, name = c, k
        assert found[i]["licence"] == (name if best >= 0.8 else None), (i, best, name)


def test_licence_bodies_headers_and_notices_inside_a_line(spark):
    code = "\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(60))
    cases = [("copyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + text, name.removesuffix(".header")) for name, text in licences.BODIES.items()]
    cases += [("\n".join("# " + x for x in text.split("\n")) + "\n" + code, name.removesuffix(".header")) for name, text in licences.BODIES.items()]
    cases += [(f"Copyright 2020 Jane Doe. {text} See the file for more.", name) for name, text in licences.TEMPLATES.items()]
    frame = spark.createDataFrame([(i, f"d{i}/LICENSE", True, t) for i, (t, _) in enumerate(cases)] + [(9000, "x/a", True, prose(random.Random(1), 4000)), (9001, "x/b", True, code)], "doc_id long, path string, is_file boolean, text string")
    found = {r["doc_id"]: r["licence"] for r in licences.scan(frame).collect()}
    wrong = [(i, found[i], name) for i, (_, name) in enumerate(cases) if found[i] != name]
    assert not wrong and found[9000] is None and found[9001] is None


def test_nearest_ancestor_wins(spark):
    rows = [(1, "r/LICENSE", True, "MIT", 1.0, 0), (2, "r/a/LICENSE", True, "GPL-3.0", 0.9, 0), (3, "r/a/b/c.txt", False, None, 0.0, -1), (4, "r/z.txt", False, None, 0.0, -1), (5, "q/z", False, None, 0.0, -1), (6, None, False, None, 0.0, -1), (7, "r/a/b/d", False, "Apache-2.0", 1.0, 2), (8, "r/a/COPYING", True, "MPL-2.0", 0.95, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, path string, is_file boolean, licence string, cosine double, line int")
    found = {r["doc_id"]: (r["effective"], r["from_dir"], r["up"]) for r in licences.inherit(frame).collect()}
    assert found == {1: ("MIT", None, None), 2: ("GPL-3.0", None, None), 3: ("MPL-2.0", "r/a", 1), 4: ("MIT", "r", 0), 5: (None, None, None), 6: (None, None, None), 7: ("Apache-2.0", None, None), 8: ("MPL-2.0", None, None)}


def test_licences_of_nothing(spark):
    frame = empty(spark).select("doc_id", F.lit("a").alias("path"), F.lit(True).alias("is_file"), "text")
    assert licences.inherit(licences.scan(frame)).count() == 0


# --- op3, op4 -------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_equals_the_library(name):
    rng = random.Random(5)
    codec, pieces = bpe.codec(P.path(name)), vocab.PieceEncoder(P.path(name))
    odd = ["ab" * 9000, "".join(rng.choice("abcdehinort") for _ in range(20000)), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(5000)), "don't I'M ''s  \n\n x", "á ŉ ſ ­"]
    given = [t or "" for t in texts(6)] + odd
    for text, raw in zip(given, pieces.encode(given)):
        ids = codec.library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids == np.frombuffer(raw, "<u4").tolist()
        assert "".join(codec.decode(ids, block=7)) == codec.library.decode(ids, skip_special_tokens=False)


def test_transducer_in_any_blocks_and_with_bounded_memory():
    pairs = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "a"), ("bc", "a")]
    merges = bpe.Merges(pairs, {s: i for i, s in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "bca"])})
    rng = random.Random(7)
    for _ in range(100):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 200)))
        whole = [merges.ids[t] for t in bpe.merge(list(text), merges.rank)]
        assert whole == [merges.ids[t] for t in bpe._merge_long(list(text), merges.rank)]
        machine, out = bpe.Transducer(merges, block=4), []
        for i in range(0, len(text), 3):
            out += machine.feed(text[i : i + 3])
            assert len(machine.held) <= merges.lookahead + 3 * machine.block
        assert out + machine.close() == whole


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_stream_of_long_texts_equals_the_library(name):
    use, library, rng = bpe.Codec(P.path(name)), vocab.load(P.path(name)), random.Random(4)
    for text in (prose(rng, 40_000), "ab" * 60_000 + " c", prose(rng, 20_000) + " 漢字 <|endoftext|> " + prose(rng, 20_000) + "\n\n  x" + "7" * 3000):
        blocks = list(use.stream(text, 512))
        assert len(blocks) > 3 and max(map(len, blocks)) < 9000
        assert [i for b in blocks for i in b] == library.encode(text, add_special_tokens=False).ids
        assert "".join(use.decode(i for b in blocks for i in b)) == library.decode([i for b in blocks for i in b], skip_special_tokens=False)


def test_improper_merge_lists_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges([("ab", "c"), ("a", "b")], {})


def test_shards_round_trip():
    rng = np.random.default_rng(8)
    parts = [rng.integers(0, high, n).astype("<u4") for high, n in ((10, 5), (1 << 20, 70), (300, 0), (70000, 3))]
    keys = [5, None, 7, -1]
    found, lengths, ids = tokenfile.read_shard(tokenfile.shard(keys, [p.tobytes() for p in parts]))
    assert found == keys and lengths.tolist() == [len(p) for p in parts] and ids.tolist() == np.concatenate(parts).tolist()
    for n in (0, 1, 3, 4, 5, 1000):
        v = rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)
        control, data = tokenfile.pack(v.astype("<u4"))
        assert tokenfile.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n, block=3).tolist() == v.tolist()


def test_token_files(spark, docs, tmp_path):
    path = P.path("byte_bpe_50k.json")
    tokenfile.write(docs, path, f"{tmp_path}/t", shard_tokens=500)
    rows = sorted(pairs_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    library, at, want = vocab.load(path), 0, []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokenfile.digest(spark, f"{tmp_path}/t").collect()), key=lambda r: r[1]) == want
    files = tokenfile.save_files(spark, f"{tmp_path}/t", f"file://{tmp_path}/out")
    assert files == len(list((tmp_path / "out").glob("*.tvb"))) > 3
    tokenfile.write(empty(spark), path, f"{tmp_path}/e")
    assert tokenfile.digest(spark, f"{tmp_path}/e").count() == 0


def test_round_trip_of_nothing_and_of_null(spark, docs):
    path = P.path("word_bpe_49k.json")
    assert bpe.round_trip(empty(spark), path).count() == 0
    ids = bpe.encode(docs, path)
    assert bpe.decode(ids, path).count() == docs.count()


# --- op5 ------------------------------------------------------------------------------


def test_scores(spark, docs):
    rest = common.remainder("doc_id", 5)
    found = lm.score(docs, rest != 1, rest == 2).collect()
    rows = [(i, (t or "").encode().lower().split() + [None]) for i, t in pairs_of(docs)]
    train = [(i, w) for i, w in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(x for _, w in train for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in rows), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found), key=str) == want
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in found)
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)
    assert lm.score(empty(spark), rest != 1, rest == 2).count() == 0


def brute_mixture(rows):
    """Scores by the module's formula on plain dictionaries; weights by expectation-maximisation on exact estimates."""
    END, START = "END", "START"
    cut = [(i, (t or "").encode().lower().split() + [END]) for i, t in rows]
    kind = [None if i is None else zlib.crc32(str(i).encode()) % 5 for i, _ in cut]

    def counted(chosen):
        words, pairs = collections.Counter(), collections.Counter()
        for (_, w), k in zip(cut, kind):
            if chosen(k):
                words.update(w)
                pairs.update(zip([START, *w], w))
        words[START] = words[END]
        return words, pairs, sum(words.values()) - words[START], len(words) - (words[START] >= 0) - (0 if words[END] else 1)

    def estimates(w, counts):
        words, pairs, n, v = counts
        for u, x in zip([START, *w], w):
            c = words[u]
            yield min(lm.CONTEXTS - 1, c.bit_length()), (pairs[u, x] / c if c else 0.0, words[x] / max(n, 1), 1 / (v + 1), float(words[x] == 0))

    left = counted(lambda k: k is not None and k not in (1, 2))
    seen = [e for (_, w), k in zip(cut, kind) if k == 2 for e in estimates(w, left)]

    def em(p, start, lean):
        weights = start
        for _ in range(60):
            share = weights * p
            share /= share.sum(1, keepdims=True)
            weights = share.sum(0) + lean * start
            weights = weights / weights.sum()
        return weights

    pooled = em(np.array([p for _, p in seen]), np.full(4, 0.25), 0.0)
    weights = {c: em(np.array([p for b, p in seen if b == c]), pooled, 20.0) for c in {b for b, _ in seen}}
    every = counted(lambda k: k is not None and k != 1)
    out = []
    for i, w in cut:
        total = 0.0
        for b, p in estimates(w, every):
            mine = weights.get(b, pooled).copy()
            if not b:
                mine[0] = 0
                mine /= mine.sum()
            total += np.log10(max(1e-300, mine @ np.array(p)))
        out.append((i, len(w), total))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_tokens", [1 << 20, 40])
def test_mixture_equals_plain_recomputation(spark, docs, block_tokens):
    rest = common.remainder("doc_id", 5)
    found = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in lm.score(docs, rest != 1, rest == 2, block_tokens).collect()), key=str)
    want = brute_mixture(pairs_of(docs))
    assert [f[:2] for f in found] == [w[:2] for w in want]
    # weights are learned on estimates rounded to quarters of a doubling
    assert sum(f[2] for f in found) == pytest.approx(sum(w[2] for w in want), rel=2e-3)
    assert all(f[2] == pytest.approx(w[2], rel=0.03, abs=0.05) for f, w in zip(found, want))


def test_counts_beyond_32_bits():
    values = np.array([0, 1, 255, 5_000_000_000, 1 << 50])
    back, behind = lm._from_planes(lm._planes(values) + b"rest", 5)
    assert back.tolist() == values.tolist() and behind == 1 + 5 * 7


def test_words_of_a_very_long_text():
    rng = random.Random(9)
    raw = " ".join("w" * rng.randrange(1, 9) + str(rng.randrange(999)) for _ in range(30_000)).encode() + b"\n" + b"x" * 50_000 + b" end"
    for most in (1, 100, 1 << 20):
        h, n = common.words_and_lengths(raw, most)
        assert n.tolist() == [len(w) for w in raw.split()] and (h == common.words_and_lengths(raw, 1 << 30)[0]).all()


def test_weights_are_distributions_and_follow_the_data():
    cells = np.array([[5, 3, 30, 900], [5, -1, 30, 60], [5, -1, -1, 40], [0, -1, 30, 90], [0, -1, -1, 10]])
    w = lm.learn(cells, 1000)
    assert w.sum(1) == pytest.approx(np.ones(lm.CONTEXTS)) and w[0, 0] == 0 and w[5, 0] > 0.7


# --- op6 ------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(30)}
    runs = packing.plan(counts, 64)
    bins = collections.defaultdict(list)
    for length, n in counts.items():
        b, o = packing.place(runs, np.full(n, length), np.arange(n))
        for x, y in zip(b.tolist(), o.tolist()):
            bins[x].append((y, length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(k * n for k, n in counts.items())
    assert len(bins) <= -(-total // 64) * 1.25 + 1


def test_exchange_fills_a_gap():
    left = np.zeros(11, np.int64)
    left[[6, 3, 2]] = [1, 1, 2]
    pattern, gap = packing._fill(left, 6, 10)
    assert (pattern, gap) == ([(6, 1), (3, 1)], 1)
    assert packing._exchange(pattern, gap, left) == [(6, 1), (2, 2)]


def test_packing(spark, docs):
    found = packing.pack(docs, P.path("word_bpe_49k.json"), 64).collect()
    library, want = vocab.load(P.path("word_bpe_49k.json")), []
    for i, t in pairs_of(docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in by.values():
        content.sort()
        assert content[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(content, content[1:])) and sum(n for _, n in content) <= 64
    assert packing.pack(empty(spark), P.path("word_bpe_49k.json")).count() == 0


# --- op7 ------------------------------------------------------------------------------


def test_rules_equal_brute_force(spark, docs):
    again = "a b c d e f g h i a b c d e f g h i j " * 3
    frame = docs.unionByName(spark.createDataFrame([(900, again, None, None, None), (901, "x\n" * 30 + "y | # $", None, None, None), (902, "w " * 40, None, None, None)], DOCS), True)
    found = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rules.verdicts(frame).collect()), key=str)
    want = []
    for i, t in pairs_of(frame):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert found == sorted(want, key=str)
    assert rules.verdicts(empty(spark)).count() == 0


def test_policies_and_ablation(spark):
    table = spark.createDataFrame([(0,), (1,), (3,), (2,), (2,), (1 << 7,)], "failed long")
    assert [r["kept"] for r in rules.apply_policy(table, "base").collect()] == [True, False, False, False, False, True]
    found = {r["rule"]: (r["fails"], r["only"], r["kept_without"]) for r in rules.ablation(table, "base").collect()}
    assert found == {"few_words": (2, 1, 3), "repeated_words": (3, 2, 4)}


# --- op8, op10 ------------------------------------------------------------------------

SOUNDS = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "un", "ge", "ber"], "cc": ["ção", "que", "nh", "lo"]}


def labelled(spark, n=240):
    rng = random.Random(9)
    word = lambda lang: "".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(3, 60))), lang, "s", 1) for i, lang in ((i, rng.choice(list(SOUNDS))) for i in range(n))]
    return spark.createDataFrame(rows + [(n, None, "aa", "s", 1), (n + 1, "12 ² !", "aa", "s", 1), (n + 2, "", None, "s", 1), (None, "kato", "aa", "s", 1)], DOCS)


def test_languages_of_held_out_texts(spark):
    frame = labelled(spark)
    rows = langid.identify(frame).join(frame.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["text"] and r["doc_id"] < 240]
    assert len(held) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    assert all((r["lang_pred"] == "und") == (r["doc_id"] >= 240) and 0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2} == {True}
    assert langid.identify(empty(spark)).count() == 0
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_quality_of_held_out_texts(spark):
    rng = random.Random(10)
    junk = lambda: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, rng.randrange(20, 80)).split())
    rows = [(i, prose(rng, rng.randrange(20, 80)) if i % 5 else junk(), int(i % 5 > 0)) for i in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3] + [(7, None), (None, 1), (1, 1), (1, 1)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in pulearn.classify(frame, labels).collect()}
    held = [(found[i], q) for i, _, q in rows if found[i]["held_out"]]
    assert len(held) > 40 and np.mean([r["predicted"] == q for r, q in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    assert pulearn.classify(empty(spark), labels).count() == 0
    assert {r["score"] for r in pulearn.classify(frame, labels.limit(0)).collect()} == {0.5}


def test_risk_gradients_equal_differences():
    rng = np.random.default_rng(1)
    layers = [rng.normal(size=(pulearn.MEASURES, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]
    p, u = rng.normal(size=(7, pulearn.MEASURES)) / 4, rng.normal(size=(9, pulearn.MEASURES)) / 4
    _, _, up, down = pulearn.risk(layers, p, u, 0.3)
    for k, w in enumerate(layers):
        for at in rng.integers(0, w.size, 5):
            moved = [[x.copy() for x in layers] for _ in range(2)]
            for sign, other in zip((1, -1), moved):
                other[k].reshape(-1)[at] += sign * 1e-6
            for i, grads in enumerate((up, down)):
                slope = (pulearn.risk(moved[0], p, u, 0.3)[i] - pulearn.risk(moved[1], p, u, 0.3)[i]) / 2e-6
                assert grads[k].reshape(-1)[at] == pytest.approx(slope, abs=1e-6)


@pytest.mark.parametrize("prior", [0.2, 0.6, 0.9])
def test_prior_from_positives_and_unlabelled_rows(prior):
    rng = np.random.default_rng(3)
    make = lambda n, at: rng.normal(at, 1, (n, pulearn.MEASURES))
    positive = make(3000, 0.3)
    unlabelled = np.concatenate([make(int(4000 * prior), 0.3), make(4000 - int(4000 * prior), -0.3)])
    halves = rng.random(3000) < 0.5, rng.random(4000) < 0.5
    assert pulearn.estimated_prior(positive, unlabelled, halves) == pytest.approx(prior, abs=0.05)


# --- op9 ------------------------------------------------------------------------------


def test_embedding_dedup_compares_labels_as_they_are(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], "b"), (4, [2.0, 4.0], "b")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rpforest.near_duplicates(frame).collect()) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3)]
    frame = frame.withColumn("label", F.when(F.col("vec_id") == 1, 1.2).when(F.col("vec_id") == 2, 1.9).when(F.col("vec_id") == 3, -0.0).otherwise(0.0))
    assert sorted((r["vec_id"], r["n_links"]) for r in rpforest.near_duplicates(frame).collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_forest_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:80] + rng.normal(size=(80, 16)) * 0.15, base[:40]])
    label = [int(v) for v in rng.integers(0, 2, 300)]
    label += label[:80] + label[:40]
    rows = [(i, [float(v) for v in r], k) for i, (r, k) in enumerate(zip(x, label))]
    rows += [(500, [0.0] * 16, 0), (501, None, 0), (502, [float("nan")] * 16, 0), (503, rows[0][1], None), (504, [1.0, None] * 8, 1), (505, [1.0, 2.0], 0), (506, [2.0, 4.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(len(x), dtype=bool)
    found = {r["vec_id"]: r for r in rpforest.Forest(leaf=40, block=25).components(frame).collect()}
    links = np.array([found[i]["n_links"] for i in range(len(x))])
    assert links.sum() >= 0.9 * near.sum() and (links <= near.sum(1)).all()
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in (500, 501, 502, 503, 504))
    assert found[506]["component_id"] == 505 and not found[506]["kept"]
    assert all(found[380 + i]["component_id"] <= i for i in range(40))
    assert rpforest.near_duplicates(frame.limit(0)).count() == 0


def test_embedding_dedup_keeps_links_of_a_large_tight_group(spark):
    rng = np.random.default_rng(5)
    centre, around = rpforest.unit(rng.normal(size=(1, 64))), rng.normal(size=(1000, 64))
    around = rpforest.unit(around - (around @ centre.T) * centre)
    x = np.concatenate([np.sqrt(0.94) * centre + np.sqrt(0.06) * around, rpforest.unit(rng.normal(size=(2000, 64)))])
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r["n_links"] for r in rpforest.near_duplicates(frame).collect()}
    links = np.array([found[i] for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.995 * near.sum()
    assert (links >= 0.9 * near.sum(1)).all()


def test_embedding_dedup_links_classes_without_ids(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 16))
    rows = [(9, a.tolist(), 0), (None, (a * 1.01 + 0.001).tolist(), 0), (None, (a * 1.01 + 0.001).tolist(), 0), (4, (a + 0.002).tolist(), 0), (5, b.tolist(), 0), (None, (-b).tolist(), 0)]
    found = rpforest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found), key=str)
    assert got == sorted([(9, 3, 4, False), (4, 3, 4, True), (None, 3, 4, False), (None, 3, 4, False), (5, 0, 5, True), (None, 0, None, False)], key=str)
