"""Quality rules as a bitmask ledger, in Spark SQL functions alone.

`ledger` measures every text once and keeps the measurements and, in one long, a bit for each rule that the text fails.
Policies are versioned masks over those bits: applying one, or asking what a rule costs, reads the ledger and no text.

Nulls: a null text has no words. Repeated rows each have a row; an empty table gives an empty ledger; very long texts
are one row like any other (arrays of their words, no exchange). Columns of the same names in the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import text_or_empty

#: What separates words, and what counts as a symbol.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

#: Rule names by bit, with their test on the measurements. Bits are never reused; new rules come at the end.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    ("long_words", "n_words > 0 and word_chars > 40 * n_words"),
]
BIT = {name: k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "base-1": ["too_few_words", "repeated_words"],
    "web-1": ["too_few_words", "repeated_words", "symbols", "duplicate_lines"],
    "web-2": [name for name, _ in RULES],
}
CURRENT = "web-2"


def mask(policy: str | list[str]) -> int:
    return sum(1 << BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measurements(text: Column) -> dict[str, Column]:
    """By name, over a text without nulls. Each is computed inside the row; nothing is exploded or exchanged."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bare = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    size = F.length(text)
    return {
        "words": words,
        "lines": bare,
        "word_chars": F.length(_without(text, SPACES)).cast("bigint"),
        "n_symbols": (size - F.length(_without(text, SYMBOLS))).cast("bigint"),
    }


def repeated_words(sorted_windows: Column) -> Column:
    """Words that lie in a window found at least twice, from (window, place) sorted."""
    last = F.size(sorted_windows) - 1

    def twice(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(sorted_windows, i - 1).window == x.window).otherwise(F.lit(False))
        behind = F.when(i < last, F.get(sorted_windows, i + 1).window == x.window).otherwise(F.lit(False))
        return before | behind

    places = F.transform(F.filter(sorted_windows, twice), lambda x: x.at)
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words: long) and
    failed (long: bit k is set if rule k fails)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", *(c.alias(name) for name, c in measurements(F.col("text")).items()))
    words, lines = F.col("words"), F.col("lines")
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_words"), "word_chars", "n_symbols", F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"), "words", hashes.alias("hashes"))
    rows = rows.select("*", F.explode(F.array(F.when(n >= 3, F.transform(F.slice("hashes", 1, n - 2), lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)))))).alias("prints"))
    # only a text whose windows' 64-bit hashes are not all different is looked at further: its windows themselves are sorted
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    ordered = F.when(F.size("prints") > F.size(F.array_distinct("prints")), F.sort_array(F.transform("prints", lambda h, i: F.struct(h.alias("hash"), window(i).alias("window"), i.alias("at")))))
    rows = rows.select("*", F.explode(F.array(ordered)).alias("ordered"))
    repeats = F.coalesce(F.when(F.col("ordered").isNotNull(), repeated_words(F.col("ordered"))), F.lit(0)).cast("bigint")
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))
    bits = [F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, (_, test) in enumerate(RULES)]
    return rows.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def fails(policy: str | list[str]) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("bigint")) != 0


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: n_failed, n_alone (texts that it alone rejects, and that would stay without it) and
    n_kept_without. The ledger is first counted by its masked bits: at most 2^rules groups, however many texts."""
    masked = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("bigint"))
    counts = book.groupBy(masked.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("bigint").alias("bit")) for r in POLICIES[policy]))
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("bigint")
    return each.groupBy("rule").agg(total(hit).alias("n_failed"), total(F.col("bits") == F.col("bit")).alias("n_alone"), total(rest == 0).alias("n_kept_without"))
