"""Line deduplication against brute force, over both ways of applying confirmed keys."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import linededup, queries

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_docs, min_chars, keep):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    seen = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")} if len(k) >= min_chars)
    bad = {k for k, n in seen.items() if n >= min_docs}
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = set()
        for x in t.split("\n"):
            if key(x) in bad:
                first.setdefault(key(x), (i, t))
    for i, t in rows:
        lines, own, stays = t.split("\n"), set(), []
        for x in lines:
            k = key(x)
            if k not in bad or (keep == "first" and first[k] == (i, t) and k not in own):
                own |= {k} & bad
                stays.append(x)
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return Counter(out)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "\n".join(f" {'aB'[rng.integers(2)]}É{rng.integers(60)}\t" if rng.integers(3) else f"own {k} {j}" for j in range(rng.integers(1, 9)))) for k in range(120)]
    rows += [(200, None), (201, ""), (None, "x\n\nx\n aÉ1"), (202, " \x0b\n \n" * 50), (203, "long " * 60_000 + "\nbÉ2")] + [(204 + k, "Same line \nx") for k in range(11)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"key": F.lit(1), "row": F.lit("r"), "found": F.lit(2)}).repartition(5)


@pytest.mark.parametrize("most", [10**6, 0])
@pytest.mark.parametrize(("min_docs", "min_chars", "keep"), [(10, 1, "none"), (3, 4, "none"), (2, 1, "first")])
def test_against_brute_force(docs, most, min_docs, min_chars, keep):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = linededup.dedup_lines(docs, min_docs, min_chars, keep, filter_bits=1 << 12, most_broadcast=most).collect()
    assert Counter(map(tuple, got)) == brute(rows, min_docs, min_chars, keep)


def test_repeated_rows_and_empty_table(spark, docs):
    twice = spark.createDataFrame([(1, "a\nb")] * 10, "doc_id bigint, text string")
    assert {tuple(r) for r in linededup.dedup_lines(twice).collect()} == {(1, 2, 2, "")}
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_filter_misses_no_repeated_key(docs):
    packed = linededup.twice_filter(docs, 1, 1 << 14)
    seen = Counter(k for r in docs.collect() for k in set(linededup.keys_of((r.text or "").encode(), 1)) if k)
    again = [k for k, n in seen.items() if n > 1]
    assert linededup._suspected(again, packed, 1 << 14).all()
    once = [k for k, n in seen.items() if n == 1]
    assert linededup._suspected(once, packed, 1 << 14).mean() < 0.2


def test_query(spark, small):
    r = queries.op5_line_dedup(spark, small)
    assert r.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and r.count() == 200
