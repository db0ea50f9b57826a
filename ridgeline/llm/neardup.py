"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

1. Document frequencies of all five-word shingles over all documents are counted in one fixed array of counters. A
   counter's excess is on average (shingles a document / WIDTH) of the number of documents, at every corpus size.
2. A shingle weighs (1 + ln tf) * (IDF_FLOOR + (1 - IDF_FLOOR) * ln((1 + N) / (1 + df)) / ln(1 + N)). The floor is high
   on purpose: a plain IDF lowers just those shingles that a large group of copies shares, and would take the group
   apart at a similarity of 0.8.
3. Texts of equal words become one node, so copies are never compared. Each node gets BANDS * ROWS consistent weighted
   samples; nodes that agree in all samples of a band share a bucket. At similarity 0.8, 99.8 % of pairs do.
4. Inside a bucket no list of all pairs is made. Every node is verified against one pivot; nodes that fail against a few
   members of the pivot's class that the triangle inequality leaves possible (weighted Jaccard distance is a metric).
   What is still outside is joined to its buckets' members by prefixes: of each text only its rarest shingles, as many as
   two texts of similarity 0.8 must share one of. Texts that have just a widespread passage in common never meet there.
   No partner or candidate is capped.
5. Links of weighted Jaccard similarity of at least 0.8 are joined to classes in Spark.

Nulls: a null text is empty; texts without a word are copies only of equal texts; a null doc_id takes part, and a class's
id is its least doc_id (null if it has none). Repeated rows each give a row. A similarity of exactly the threshold is a
link. An empty table gives an empty table, very long texts are one node like any other, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import WORD, components, in_bytes, in_packed, join_skewed, mix, packed_union, settle, shingles, text_or_empty, tidy, unused

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
WIDTH = 1 << 20
IDF_FLOOR = 0.9
ANCHORS = 16
#: Prefix entries of the texts still outside that tasks may hold in memory at once; more are joined.
MOST_INDEXED = 500_000
NEEDED_BITS = 1 << 26

_SEGMENTS = 64
_rng = np.random.default_rng(11)
_SEEDS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32) + np.float32(1e-6)
_INVERSE_R = (1 / _R).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16) + 1e-12).astype(np.float32)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Weights:
    """Weights of shingles, from the corpus's counters."""

    def __init__(self, counters: np.ndarray, n_docs: int, floor: float = IDF_FLOOR):
        scale = np.log1p(np.maximum(n_docs, 1))
        idf = np.clip((scale - np.log1p(np.minimum(counters, n_docs))) / scale, 0, 1)
        self.by_counter = (floor + (1 - floor) * idf).astype(np.float32)

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.by_counter[(hashes & np.uint64(len(self.by_counter) - 1)).astype(np.int64)] * (1 + np.log(counts)).astype(np.float32)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def node_of(text: str, words: list[str]) -> bytes:
    """Equal for texts of equal words; for texts without a word, for equal texts."""
    return xxhash.xxh3_128_digest("\x1f".join(words) if words else "\x00" + text)


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, text and mark, which with the id names the row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), _mark().alias("mark"))


def _mark() -> Column:
    return F.xxhash64(text_or_empty())


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column(1).to_pylist()


def count_shingles(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Counters of document frequency (a shingle counts at its hash modulo width) and the number of documents."""
    size = width // _SEGMENTS
    schema = pa.schema([("segment", pa.int32()), ("counts", pa.binary()), ("n", pa.int64())])

    def pack(totals: dict[int, np.ndarray], n: dict[int, int]) -> pa.RecordBatch:
        rows = [{"segment": s, "counts": zlib.compress(c.astype("<i8").tobytes(), 1), "n": n.get(s, 0)} for s, c in totals.items()]
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, held, waiting = np.zeros(width, np.int64), 0, [], 0
        for batch in in_bytes(batches):
            for text in _texts(batch):
                n += 1
                held.append(np.unique(shingles(words_of(text), SIZE)))
                waiting += len(held[-1])
                if waiting > 2_000_000:
                    total += np.bincount((np.concatenate(held) & np.uint64(width - 1)).astype(np.int64), minlength=width)
                    held, waiting = [], 0
        if held:
            total += np.bincount((np.concatenate(held) & np.uint64(width - 1)).astype(np.int64), minlength=width)
        parts = {s: total[s * size : (s + 1) * size] for s in range(_SEGMENTS)}
        yield pack({s: c for s, c in parts.items() if s == 0 or c.any()} if n else {}, {0: n})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in batches:
            for s, c, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                totals[s] = totals.get(s, 0) + np.frombuffer(zlib.decompress(c), "<i8")
                n[s] = n.get(s, 0) + k
        yield pack(totals, n)

    kind = "segment int, counts binary, n bigint"
    out, n_docs = np.zeros(width, np.int64), 0
    for r in _slim(docs).mapInArrow(tidy(count), kind).repartition("segment").mapInArrow(add, kind).collect():  # 8 * width bytes
        out[r.segment * size : (r.segment + 1) * size] = np.frombuffer(zlib.decompress(r.counts), "<i8")
        n_docs += r.n
    return out, n_docs


def samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, n_samples: int = BANDS * ROWS) -> np.ndarray:
    """Consistent weighted samples (documents x n_samples) of weighted sets laid end to end; starts: where each begins.

    For sample k a shingle draws r, c ~ Gamma(2, 1) and b ~ U(0, 1), fixed by its hash; t = floor(ln w / r + b), and the
    shingle of the least ln c - r (t - b + 1) is drawn with its t."""
    lengths = np.diff(np.append(starts, len(hashes)))
    owner, log_w = np.repeat(np.arange(len(starts)), lengths), np.log(weights)
    out = np.empty((len(starts), n_samples), np.uint64)
    for k in range(n_samples):
        x = (hashes ^ _SEEDS[k]) * _M1
        x ^= x >> np.uint64(29)
        x *= _M2
        parts = x.view(np.uint16).reshape(-1, 4)
        r_at = parts[:, 3].astype(np.intp)
        r, b = _R[r_at], parts[:, 1].astype(np.float32)
        b *= np.float32(1 / 65536)
        t = log_w * _INVERSE_R[r_at]
        t += b
        np.floor(t, out=t)
        a = t - b
        a += np.float32(1)
        a *= r
        np.subtract(_LOG_C[parts[:, 2].astype(np.intp)], a, out=a)
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(least, lengths))
        hit = hit[np.searchsorted(owner[hit], np.arange(len(starts)))]
        out[:, k] = mix(hashes[hit] * _M2 + t[hit].astype(np.int64).astype(np.uint64))
    return out


def bands_of(drawn: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.empty((len(drawn), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(drawn), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * _M1 + drawn[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def signatures(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, mark, node, bands: array of BANDS longs, empty for texts without a word."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = shared.value
        for batch in in_bytes(batches):
            nodes, bands, chunk, held = [], [], [], 0
            for text in [*_texts(batch), None]:
                if text is not None:
                    words = words_of(text)
                    nodes.append(node_of(text, words))
                    bands.append([])
                    if words:
                        h, c = np.unique(shingles(words, SIZE), return_counts=True)
                        chunk.append((len(bands) - 1, h, weights.of(h, c)))
                        held += len(h)
                if chunk and (text is None or held > 32_768):
                    starts = np.cumsum([0] + [len(h) for _, h, _ in chunk[:-1]])
                    drawn = samples(np.concatenate([h for _, h, _ in chunk]), np.concatenate([w for *_, w in chunk]), starts)
                    for (k, *_), row in zip(chunk, bands_of(drawn), strict=True):
                        bands[k] = row
                    chunk, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return _slim(docs).mapInArrow(tidy(sign), "doc_id bigint, mark bigint, node binary, bands array<bigint>")


def prefix(hashes: np.ndarray, weights: np.ndarray, order: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in an order that all texts share (rarest first), up to where what follows weighs less than
    threshold of all, and for each the weight from it on. Texts whose prefixes have no shingle in common are less
    similar than threshold; at the first that they have in common, they share no more than either has from there on."""
    first = np.lexsort((hashes, -order))
    done = np.cumsum(weights[first].astype(float))
    n = int((done[-1] - done >= (threshold - 1e-6) * done[-1]).sum()) + 1
    return hashes[first[:n]], (done[-1] - done + weights[first])[:n]


def features(docs: DataFrame, needed: DataFrame, shared: Broadcast, threshold: float = THRESHOLD) -> DataFrame:
    """node, hashes (sorted shingle hashes, repeated as they repeat, as bytes), total weight, prefix (shingle hashes) and
    rest (the weight from each of them on) of the needed nodes.

    A fixed-size filter over the needed nodes lets the other texts go where they are read; the join makes it exact."""
    places = needed.select((F.conv(F.concat(*(F.substring(F.hex("node"), k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("bigint") % NEEDED_BITS).alias("at"))
    packed = docs.sparkSession.sparkContext.broadcast(packed_union(places, NEEDED_BITS))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_bytes(batches):
            rows = {}
            for text in _texts(batch):
                words = words_of(text)
                node = node_of(text, words)
                at = int.from_bytes(node[:4], "little") % NEEDED_BITS
                if words and node not in rows and in_packed(packed.value, np.array([at]))[0]:
                    s = shingles(words, SIZE)
                    h, c = np.unique(s, return_counts=True)
                    w = shared.value.of(h, c)
                    first, rest = prefix(h, w, shared.value.of(h, np.ones_like(c)), threshold)
                    rows[node] = (np.sort(s).tobytes(), float(w.sum(dtype=float)), first.view(np.int64), rest)
            columns = [[*rows], *([r[k] for r in rows.values()] for k in range(4))]
            kinds = (pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["node", "hashes", "total", "prefix", "rest"])

    found = _slim(docs).mapInArrow(tidy(vectors), "node binary, hashes binary, total double, prefix array<bigint>, rest array<double>")
    kept = found.join(needed.select("node").distinct(), "node", "left_semi")
    return kept.groupBy("node").agg(*(F.first(c).alias(c) for c in ("hashes", "total", "prefix", "rest")))


def similarity(a: np.ndarray, b: np.ndarray, weights: Weights) -> float:
    """Weighted Jaccard similarity of two sorted multisets of shingle hashes."""
    (ha, ca), (hb, cb) = (np.unique(x, return_counts=True) for x in (a, b))
    wa, wb = weights.of(ha, ca), weights.of(hb, cb)
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    shared = float(np.minimum(wa[both], wb[at[both]]).sum())
    return shared / (float(wa.sum()) + float(wb.sum()) - shared)


def verified(pairs: DataFrame, vectors: DataFrame, shared: Broadcast) -> DataFrame:
    """pairs (a, b: nodes) with their similarity."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            found = [similarity(*(np.frombuffer(c[k].as_buffer(), np.uint64) for c in (x, y)), shared.value) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], schema=schema)

    v = vectors.select("node", "hashes")
    both = pairs.select("a", "b").distinct().join(v.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(v.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(measure, "a binary, b binary, similarity double")


def links(docs: DataFrame, signed: DataFrame, shared: Broadcast, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity: verified links between nodes that join everything which the buckets hold together."""
    bucketed = signed.select("node", F.explode("bands").alias("band")).distinct()
    shared_bands = settle(bucketed.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    members = settle(join_skewed(bucketed, shared_bands, "band").select("band", "node", "pivot"), "members")
    vectors = settle(features(docs, members.select("node").distinct(), shared, threshold))

    def check(pairs: DataFrame) -> DataFrame:
        return settle(verified(pairs, vectors, shared))

    # 1: against the pivot
    first = check(members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    close = members.where("node <> pivot").join(first, (F.col("node") == F.col("a")) & (F.col("pivot") == F.col("b"))).select("band", "node", "pivot", "similarity")
    close = settle(close)
    far = close.where(F.col("similarity") < threshold)
    if far.isEmpty():
        return first.where(F.col("similarity") >= threshold)
    label = _labels(first, threshold)

    def outside(label: DataFrame) -> DataFrame:
        """Members of buckets that are not known to be in their pivot's class, with their own label."""
        own = far.join(label, "node", "left").withColumn("own", F.coalesce("label", "node")).drop("label")
        of_pivot = label.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label"))
        return own.join(of_pivot, "pivot", "left").where(F.col("own") != F.coalesce("pivot_label", "pivot")).drop("pivot_label")

    # 2: against a few members of the pivot's class
    slot = F.pmod(F.xxhash64("node", "band"), F.lit(ANCHORS))
    anchors = close.where(F.col("similarity") >= threshold).groupBy("band", slot.alias("slot")).agg(F.min(F.struct("node", "similarity")).alias("x")).select("band", F.col("x.node").alias("anchor"), F.col("x.similarity").alias("near"))
    slack = 1 - threshold + 1e-6
    tried = outside(label).join(anchors, "band").where(F.col("near") - F.col("similarity") <= slack)
    second = check(tried.select(F.col("node").alias("a"), F.col("anchor").alias("b")))
    label = _labels(first.unionByName(second), threshold)

    # 3: what is still outside, by prefixes, against the members of its buckets
    left = settle(outside(label).select("band", "node").distinct())
    involved = members.join(left.select("band").distinct(), "band").select("node").distinct()
    told = settle(vectors.join(involved, "node", "left_semi").join(label, "node", "left").select("node", "total", F.coalesce("label", "node").alias("label"), "prefix", "rest"))
    ours = told.join(left.select("node").distinct(), "node", "left_semi")
    third = check(meeting(told, ours, threshold))
    return first.unionByName(second).unionByName(third).where(F.col("similarity") >= threshold)


def meeting(told: DataFrame, ours: DataFrame, threshold: float, most: int = MOST_INDEXED) -> DataFrame:
    """a, b: pairs of a text of ours and a text of told (node, total, label, prefix, rest) that aren't known to be in one
    class and may be similar: for some common prefix shingle, the lesser of what both weigh from it on is at least the
    weight that two texts of their totals must share. For the first common one that is a bound on what they do share, so
    no similar pair is lost. Up to `most` prefix entries of ours (their number is measured) are sent to the tasks as an
    index, more are joined; the pairs are the same."""
    must = threshold / (1 + threshold) - 1e-6
    if (ours.agg(F.sum(F.size("prefix"))).first()[0] or 0) > most:
        spread = ours.select(F.explode(F.arrays_zip("prefix", "rest")).alias("x"), F.col("node").alias("one"), F.col("total").alias("weight"), F.col("label").alias("own"))
        spread = spread.select(F.col("x.prefix").alias("shingle"), F.col("x.rest").alias("ahead"), "one", "weight", "own")
        rows = told.select("node", "total", "label", F.explode(F.arrays_zip("prefix", "rest")).alias("x")).select("node", "total", "label", F.col("x.prefix").alias("shingle"), F.col("x.rest").alias("rest"))
        may = F.least("ahead", "rest") >= must * (F.col("weight") + F.col("total"))
        pairs = spread.join(rows, "shingle").where((F.col("own") != F.col("label")) & may)
        return pairs.select(F.least("node", "one").alias("a"), F.greatest("node", "one").alias("b")).distinct()
    held = told.sparkSession.sparkContext.broadcast([(bytes(r.node), r.total, bytes(r.label), list(r.prefix), list(r.rest)) for r in ours.collect()])
    kept: dict = {}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "keys" not in kept:
            owner = np.repeat(np.arange(len(held.value)), [len(r[3]) for r in held.value])
            keys, ahead = np.array([x for r in held.value for x in r[3]], np.int64), np.array([x for r in held.value for x in r[4]], float)
            order = np.argsort(keys, kind="stable")
            kept.update(keys=keys[order], owner=owner[order], ahead=ahead[order], weight=np.array([r[1] for r in held.value], float))
        for batch in batches:
            pairs = []
            for node, total, own, first, rest in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                p, r = np.array(first, np.int64), np.array(rest, float)
                lo, hi = np.searchsorted(kept["keys"], p), np.searchsorted(kept["keys"], p, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
                one = kept["owner"][at]
                may = np.minimum(kept["ahead"][at], np.repeat(r, hi - lo)) >= must * (kept["weight"][one] + total)
                for k in np.unique(one[may]):
                    if held.value[k][2] != own:
                        pairs.append((min(held.value[k][0], node), max(held.value[k][0], node)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.binary()) for k in range(2)], names=["a", "b"])

    return told.select("node", "total", "label", "prefix", "rest").mapInArrow(meet, "a binary, b binary").distinct()


def _labels(found: DataFrame, threshold: float) -> DataFrame:
    """node, label: its class as far as the links found so far tell."""
    return components(found.where(F.col("similarity") >= threshold)).withColumnRenamed("component", "label")


def classes(docs: DataFrame, threshold: float = THRESHOLD, idf_floor: float = IDF_FLOOR) -> DataFrame:
    """doc_id, mark, component (its class), class_id, class_size, n_texts of each row of docs."""
    counters, n_docs = count_shingles(docs)
    shared = docs.sparkSession.sparkContext.broadcast(Weights(counters, n_docs, idf_floor))
    signed = settle(signatures(docs, shared), "signed")
    joined = components(links(docs, signed, shared, threshold))
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    known = nodes.join(joined, "node", "left").select("node", "least", "rows", F.coalesce("component", "node").alias("component"))
    known = settle(known, "known")
    totals = known.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"), F.count(F.lit(1)).alias("n_texts"))
    by_node = known.select("node", "component").join(totals, "component")
    return signed.select("doc_id", "mark", "node").join(by_node, "node").select("doc_id", "mark", "component", "class_id", "class_size", "n_texts")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, idf_floor: float = IDF_FLOOR) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (least doc_id of its class), class_size (rows), n_texts (different
    texts in the class)."""
    return classes(docs, threshold, idf_floor).select("doc_id", "class_id", "class_size", "n_texts")


def first_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of docs whose id stands for a class (its least doc_id), all columns kept; repeated rows of an id and
    text stay once. Rows without an id stay, as ids alone don't tell which of them to keep; one_of_each does."""
    name = unused(docs, "kept_id")
    kept = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias(name)).distinct()
    chosen = docs.join(kept, docs["doc_id"] == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.unionByName(docs.where(F.col("doc_id").isNull()))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, idf_floor: float = IDF_FLOOR) -> DataFrame:
    """One row of docs for each class, all columns kept: that of the least doc_id (a null one only if there is no other), of
    equal ids that of the least hash of its text, and of rows with equal id and text any one."""
    row, mark = unused(docs, "row_id"), unused(docs, "row_mark")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    kept = classes(docs, threshold, idf_floor).groupBy("component").agg(first)
    known = F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias(row)  # no id has the empty name
    named = docs.withColumns({row: F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")), mark: _mark()})
    return named.join(kept.select(known, F.col("first.mark").alias(mark)).distinct(), [row, mark], "left_semi").dropDuplicates([row, mark]).drop(row, mark)
