"""Quality rules as a ledger: measured once, judged by bitmask.

``ledger`` measures every document once and stores the measurements with one
bit for each failed rule.  A policy is a versioned set of rules, that is a mask:
``apply_policy`` keeps a document if it fails none of them, without touching
texts again, and ``ablation`` finds by bitwise aggregation what each rule of a
policy removes, alone or together with others.

Only DataFrame functions run here.  Everything about a document is computed from
its own row, so nothing is shuffled, and no group of rows can become hot.

Null text counts as the empty text: no words, no lines, all measurements 0.
Documents without words fail ``few_words`` and no rule that divides.  Repeated
rows and null ids stay as they are; an empty table gives an empty ledger; extra
columns are dropped.

Repeated words are found through 64-bit hashes of the windows of one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK

#: The characters that count as symbols.
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8


def measurements(text: Column) -> dict[str, Column]:
    """Measurements that need the text, by name, each over the columns of ``prepared``."""
    words, lines, hashes = F.col("_words"), F.col("_lines"), F.col("_hashes")
    n = F.size(words)
    sorted_hashes = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return {
        "n_words": n,
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _covered(sorted_hashes)).otherwise(0),
        "n_upper_words": F.size(F.filter(words, lambda w: (w == F.upper(w)) & (F.lower(w) != w) & (F.length(w) > 1))),
        "n_alpha_words": F.size(F.filter(words, lambda w: F.lower(w) != F.upper(w))),
        "n_distinct_words": F.size(F.array_distinct(words)),
        "n_stutters": F.size(F.filter(words, lambda w, i: w.eqNullSafe(F.get(words, i - 1)))),
    }


def _covered(ordered: Column) -> Column:
    """Words under windows that share their hash with another; ``ordered``: structs (h, i), sorted.

    The places of such windows, in order: each covers its eight words less those that the next one covers.
    """
    same = lambda x, other: other["h"] == x["h"]
    # element i of the sorted array has neighbours at get(i - 1) and get(i + 1), null beyond the ends
    twins = lambda a: F.filter(a, lambda x, i: F.coalesce(same(x, F.get(a, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(a, i + 1)), F.lit(False)))
    places = lambda a: F.array_sort(F.transform(twins(a), lambda x: x["i"]))
    # an array of one element binds a value once, where a lambda can use it many times
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    gaps = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, g: s + g)
    return bind(ordered, lambda a: bind(places(a), gaps))


#: Rules in the order of their bits; a rule's bit never changes its meaning, new rules are added at the end.
RULES = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "duplicate_lines": lambda m: (m["n_dup_lines"] > 1) & (100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    "upper_case": lambda m: 100 * m["n_upper_words"] > 40 * m["n_words"],
    "few_letters": lambda m: 100 * m["n_alpha_words"] < 70 * m["n_words"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 14 * m["n_words"]),
    "few_distinct": lambda m: (m["n_words"] >= 50) & (100 * m["n_distinct_words"] < 12 * m["n_words"]) & (m["n_distinct_words"] < 200),
    "stutter": lambda m: 100 * m["n_stutters"] > 20 * m["n_words"],
}
#: Policies by version: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "upper_case", "stutter"),
    "v2": tuple(RULES),
}
NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_alpha_words", "n_distinct_words", "n_stutters")


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def prepared(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, the text and its words, lines with a word, and hashes of eight-word windows."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.filter(F.split("_text", WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select(F.col(id_column), text.alias("_text")).select("*", words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words") - (WINDOW - 1)
    windows = F.when(n > 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return cut.select("*", windows.alias("_hashes"))


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, measurements..., failed long): bit i of ``failed`` is set if the i-th rule of RULES fails."""
    measured = prepared(docs, id_column, text_column)
    found = measurements(F.col("_text"))
    table = measured.select(id_column, *(found[n].cast("long").alias(n) for n in NAMES))
    m = {n: F.col(n) for n in NAMES}
    bits = [F.when(rule(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    return table.select("*", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("failed"))


def apply_policy(table: DataFrame, version: str) -> DataFrame:
    """Adds ``kept``: whether no rule of the policy has failed."""
    return table.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0)


def ablation(table: DataFrame, version: str) -> DataFrame:
    """(rule, fails, only, kept_without) for each rule of a policy.

    fails: documents that fail it; only: those that fail no other rule of the policy, which dropping the rule would keep.
    One pass: failure bits are first counted by their combination, of which there are at most 2 to the number of rules.
    """
    mask = mask_of(POLICIES[version])
    combined = table.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    bit = {name: 1 << i for i, name in enumerate(RULES) if name in POLICIES[version]}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in bit.items())))
    rows = combined.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return rows.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("fails"),
        count(F.col("bits") == F.col("bit")).alias("only"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("kept_without"),
    )


def verdicts(docs: DataFrame, version: str = "v1") -> DataFrame:
    """(doc_id, measurements..., failed, base_failed, kept) for every document."""
    table = apply_policy(ledger(docs), version)
    return table.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES["base"]))) != 0)
