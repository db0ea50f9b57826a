"""Near-duplicate classes, leaks and mixing against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import decontam, mixing, neardup
from ridgeline.llm.common import components, shingles

DOCS = "doc_id bigint, text string"


def corpus():
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))

    def edited(t, n):
        words = t.split()
        for k in rng.integers(0, len(words), n):
            words[k] = f"e{rng.integers(10**6)}"
        return " ".join(words)

    passage, rows = text(60), []
    for k in range(40):
        base = text(int(rng.integers(30, 260)))
        rows += [base, base.upper() + " ,", *(edited(base, int(rng.integers(1, 9))) for _ in range(4))]
    big = text(150)
    rows += [edited(big, int(rng.integers(1, 5))) for _ in range(120)] + [big] * 60
    rows += [f"{passage} {text(60)}" for _ in range(60)] + ["", "", None, "!!!", "!!!", "???", "one two", "One  two", "a b c d e", "long " + text(30_000)]
    return [(k * 3, t) for k, t in enumerate(rows)] + [(None, rows[0]), (0, rows[0])]


def brute_classes(rows, floor=neardup.IDF_FLOOR):
    """All links between rows by plain comparison, and each row's component."""
    texts = [t or "" for _, t in rows]
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    sets = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter({("raw", t): 1}) for w, t in zip(words, texts, strict=True)]
    sets = [s if w else s for s, w in zip(sets, words, strict=True)]
    df, n = Counter(x for s in sets for x in s), len(rows)
    weigh = lambda x, c: (1 + np.log(c)) * (floor + (1 - floor) * np.log((1 + n) / (1 + df[x])) / np.log(1 + n))
    w = [{x: weigh(x, c) for x, c in s.items()} for s in sets]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = []
    for i in range(n):
        for j in range(i):
            if w[i].keys() & w[j].keys():
                shared = sum(min(w[i][x], w[j][x]) for x in w[i].keys() & w[j].keys())
                if shared / (sum(w[i].values()) + sum(w[j].values()) - shared) >= 0.8:
                    links.append((i, j))
                    parent[find(i)] = find(j)
    return links, [find(k) for k in range(n)]


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"node": F.lit(1), "bands": F.lit("b"), "class_id": F.lit(0)}).repartition(6)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    classes = defaultdict(list)
    for r in got:
        classes[r.class_id, r.n_texts if r.class_id is None else 0].append(r.doc_id)
    for r in got:
        assert r.class_size == len(classes[r.class_id, 0]) and r.class_id == min(x for x in classes[r.class_id, 0] if x is not None)
    links, whole = brute_classes(rows)
    known = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    mine = [known.get(i, known[0]) for i, _ in rows]
    assert len(links) > 5000 and sum(mine[i] != mine[j] for i, j in links) < 0.005 * len(links)  # buckets find 99.8 % at 0.8
    assert len(set(zip(mine, whole, strict=True))) == len(set(mine))  # no class joins what isn't linked
    kept = neardup.first_of_each(docs, neardup.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.class_id for r in got} | {None})


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    one = neardup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], DOCS)).collect()
    assert [tuple(r) for r in one] == [(None, None, 2, 1)] * 2


def test_weighted_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    wa, wb = rng.uniform(0.5, 3, len(a)).astype(np.float32), rng.uniform(0.5, 3, len(a)).astype(np.float32)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    same = []
    for s in range(60):
        h = a * np.uint64(2 * s + 1)
        x = neardup.samples(np.concatenate([h, h]), np.concatenate([wa, wb]), np.array([0, len(h)]))
        same.append((x[0] == x[1]).mean())
    assert abs(np.mean(same) - want) < 0.03


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_shingles():
    assert len(shingles([])) == 0 and len(shingles(["a", "b"])) == 1 and len(shingles(list("abcdefg"))) == 3
    assert shingles(list("abcde"))[0] != shingles(list("abced"))[0]


def brute_leaks(docs, items, threshold=0.8):
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w: {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)}
    bench = {i: split(t) for i, t in items if split(t)}
    df = Counter(g for w in bench.values() for g in grams(w))
    out = {}
    for d, t in docs:
        words = split(t)
        for i, item in bench.items():
            mine, n = grams(item), min(len(item), len(words))
            for s in range(len(words) - n + 1):
                own = grams(words[s : s + n])
                if own & mine:
                    sim = sum(1 / df[g] for g in own & mine) / (sum(1 / df[g] for g in mine) + len(own - mine))
                    if sim >= threshold:
                        out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
    items = [(k, text(int(rng.integers(14, 60)))) for k in range(25)] + [(25, "tiny item"), (26, None), (27, ""), (28, "É Ü ß naïve ωmega five six")]
    items.append((29, items[3][1] + " " + text(4)))
    docs = []
    for k in range(120):
        words = text(int(rng.integers(5, 1400))).split()
        if k % 3 == 0:
            item = items[int(rng.integers(0, 30))][1] or "x"
            item = item.split()
            if k % 2 and len(item) > 30:
                item[int(rng.integers(0, 3))] = "changed"
            at = int(rng.integers(0, len(words)))
            words[at:at] = [x.upper() + "," for x in item]
        docs.append((k, " ".join(words)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, items[5][1]), (202, items[5][1]), (203, text(20_000) + " " + items[6][1])]
    d = spark.createDataFrame(docs, DOCS).withColumns({"row": F.lit(1), "words": F.lit("w"), "hits": F.lit(2), "window": F.lit(3)})
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, items)
    for slice_shingles in (decontam.SLICE_SHINGLES, 200):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(d, b, slice_shingles=slice_shingles).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    kept = decontam.without_leaks(d, b)
    assert kept.columns == d.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in docs if not any(x == i for x, _ in want))
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0


def test_near_copies_of_an_item_that_several_ids_hold(spark):
    rng = np.random.default_rng(31)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    short, long = text(50), text(100)
    items = [(0, short), (1, short), (2, long), (3, long), (4, long), (5, text(50))]
    near = lambda t, *at: " ".join("changed" if k in at else w for k, w in enumerate(t.split()))
    docs = [(0, f"{text(30)} {near(short, 20)} {text(30)}"), (1, f"{text(300)} {near(long, 30, 70)}"), (2, f"{text(9)} {near(long, 20, 40, 60, 80)}"), (3, text(200))]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(d, b).collect()}
    want = {(0, 0): 41 / 51, (0, 1): 41 / 51, (1, 2): 86 / 106, (1, 3): 86 / 106, (1, 4): 86 / 106}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert sorted(r.doc_id for r in decontam.without_leaks(d, b).collect()) == [2, 3]


def test_leaks_run_no_python(spark, small):
    plan = decontam.leaks(*(spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hamming_index_finds_all_within_the_radius(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 40)
    rows = []
    for k, x in enumerate(base):
        for bits in range(0, decontam.RADIUS + 1):
            y = int(x) & (2**64 - 1)
            for b in rng.choice(64, bits, replace=False):
                y ^= 1 << int(b)
            rows.append((k, y - 2**64 if y >= 2**63 else y))
    items = spark.createDataFrame([(k, 7, int(x)) for k, x in enumerate(base)], "item_id bigint, n_words int, fingerprint bigint")
    probes = spark.createDataFrame(rows, "k bigint, fp bigint").select("k", "fp", F.explode(decontam.blocks(F.col("fp"))).alias("b")).select("k", "fp", "b.*")
    found = probes.join(decontam.index(items), ["block", "value"]).where("k = item_id").select("k", "fp").distinct().count()
    assert found == len(set(rows))


@pytest.fixture(scope="module")
def mixed_docs(spark, small):
    odd = [(900, None, None, None), (901, "", "en", "s"), (None, "lonely words standing together", "en", None), (902, "again", "en", "s"), (902, "again", "en", "s")]
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string")).withColumns({"topic": F.lit("t"), "tokens": F.lit(1), "probability": F.lit(2)})


@pytest.mark.parametrize("most", [mixing.MOST_CELLS, 0])
def test_mixing_meets_its_targets(mixed_docs, most):
    goals = {"lang": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1, mixing.NONE: 0.0}} if most else None
    got = mixing.mix_sources(mixed_docs, budget=0.1, targets=goals, most_cells=most).toPandas()
    assert len(got) == mixed_docs.count()
    total = got.tokens.sum()
    assert abs((got.tokens * got.probability).sum() / total - 0.1) < 0.01
    raked = (got.tokens * got.factor).groupby(got["lang"].fillna(mixing.NONE)).sum() / total
    shares = got.tokens.groupby(got["lang"].fillna(mixing.NONE)).sum() / total
    want = pd.Series(goals["lang"]) if goals else mixing.targets_of(shares, 0.7)
    assert all(abs(raked[k] - want.get(k, 0)) < 0.02 for k in raked.index)
    again = mixing.mix_sources(mixed_docs, budget=0.1, targets=goals, most_cells=most).toPandas()
    assert sorted(got[got.sampled].doc_id.astype(str)) == sorted(again[again.sampled].doc_id.astype(str))
    rows = mixing.sample_documents(mixed_docs, budget=0.1, targets=goals, most_cells=most)
    assert rows.columns == mixed_docs.columns
    assert sorted(str(r.doc_id) for r in rows.collect()) == sorted("None" if pd.isna(x) else str(int(x)) for x in got[got.sampled].doc_id)


def test_raking_in_spark_is_the_drivers(spark):
    # few tokens off the diagonal: after 20 rounds factors are still 1e-4 off
    cells = [("a", "x", 0, 400), ("a", "y", 1, 2), ("b", "x", 1, 3), ("b", "y", 0, 300), ("b", "y", 1, 9), ("c", "x", 0, 0)]
    measured = spark.createDataFrame(cells, "source string, lang string, topic int, tokens bigint")
    goals = {"lang": {"x": 0.9, "y": 0.1, "none has it": 0.0}, "topic": {0: 0.25, 1: 0.75}}
    driver, cluster = ({(r.source, r.lang, r.topic): (r.factor, r.probability) for r in mixing.calibrate(measured, 0.5, targets=goals, most_cells=most).collect()} for most in (mixing.MOST_CELLS, 0))
    assert driver.keys() == cluster.keys() and all(np.allclose(driver[k], cluster[k], rtol=1e-6, atol=1e-12) for k in driver)


def test_rake_against_hand_fitted_margins():
    cells = pd.DataFrame({"source": ["a", "a", "b", "b"], "lang": ["x", "y", "x", "y"], "topic": [0] * 4, "tokens": [40, 10, 20, 30]})
    f = mixing.rake(cells, {"source": pd.Series({"a": 0.3, "b": 0.7}), "lang": pd.Series({"x": 0.5, "y": 0.5}), "topic": pd.Series({0: 1.0})})
    w = cells.tokens * f
    assert np.allclose([w[:2].sum(), w[2:].sum(), w[[0, 2]].sum()], [30, 70, 50])
    assert np.isclose(w[0] * w[3] / (w[1] * w[2]), 40 * 30 / (10 * 20))  # raking keeps the odds ratio


def test_mixing_nothing(mixed_docs):
    assert mixing.mix_sources(mixed_docs.limit(0)).count() == 0


def test_prefixes_meet_alike_by_index_and_join(spark):
    rng = np.random.default_rng(8)
    sets = [set(rng.choice(80, 20, replace=False)) for _ in range(60)]
    sets += [set(list(s)[: 20 - k % 4]) | {1000 + k} for k, s in enumerate(sets)]
    rows = []
    for k, s in enumerate(sets):
        h = np.array(sorted(s), np.uint64)
        w = (1 + (h % np.uint64(3))).astype(np.float32)
        p, rest = neardup.prefix(h, w, (h % np.uint64(7)).astype(np.float32), 0.8)
        rows.append((bytes([k]), float(w.sum()), bytes([k % 7]), p.view(np.int64).tolist(), rest.tolist()))
    told = spark.createDataFrame(rows, "node binary, total double, label binary, prefix array<bigint>, rest array<double>")
    ours = told.where("total < 39")
    found = [{(bytes(r.a), bytes(r.b)) for r in neardup.meeting(told, ours, 0.8, most).collect()} for most in (0, 10**6)]
    weight = lambda x: sum(1 + int(e) % 3 for e in x)
    similar = {(bytes([j]), bytes([i])) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if i % 7 != j % 7 and min(rows[i][1], rows[j][1]) < 39 and weight(a & b) >= 0.8 * weight(a | b)}
    assert found[0] == found[1] and similar and similar <= found[0] and len(found[0]) < 120 * 119 / 4  # fewer than half of all pairs
