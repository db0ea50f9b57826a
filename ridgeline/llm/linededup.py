"""Line deduplication with two Bloom filters.

First every task marks the keys of its lines in two filters: seen once, and seen again. The tasks' filters are merged
by segment; what two tasks have both seen counts as seen again, so no repeated key is missed. Only keys that the second
filter holds are suspected, shuffled (counted where they are read first) and confirmed exactly by a 128-bit hash of the
key and the number of documents that hold it. Texts are never shuffled while the confirmed keys fit the stated bound.

A line's key is the line without white space at either end, A-Z lower-cased. With keep="none" a confirmed key loses all
its lines; with keep="first" the line of the first document (by id, then hash of its text) that holds it stays, once.

The filters are sized by an estimate of the different lines, BITS_A_LINE each, up to MOST_BITS; a corpus that fills them
makes more keys suspects, never fewer, so it costs shuffle (of hashes, counted where they are read first) and not
correctness. Nulls: a null text is one empty line; null ids sort first. Keys shorter than min_chars are left alone.
Repeated rows are documents of their own: each counts, and with keep="first" each row that is equal to the first document
keeps its line. Very long texts are read whole. An empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import in_bytes, settle

#: The white space that a key doesn't begin or end with.
BLANK = b" \t\n\x0b\x0c\r"

BITS_A_LINE, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 27
SEGMENT_BITS = 1 << 19
#: Confirmed keys that a task may hold in memory at once (packed, 33 bytes each); beyond it they are joined.
MOST_BROADCAST = 1_000_000

LINES = "doc_id bigint, n_lines bigint, n_dropped bigint, kept string"


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """The 128-bit hash of each line's key; None for keys that are too short."""
    digest, out = xxhash.xxh3_128_digest, []
    for line in text.split(b"\n"):
        key = line.strip(BLANK).lower()
        short = len(key) < min_chars or (min_chars > 1 and len(key) < 4 * min_chars and len(key.decode()) < min_chars)
        out.append(None if short else digest(key))
    return out


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Two places of each key."""
    halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return (halves % np.uint64(bits)).astype(np.int64)


def _slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("binary").alias("text"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py()


def bits_for(docs: DataFrame) -> int:
    """A power of two: bits for a filter over the lines of docs, from an estimate of how many are different."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).agg(F.approx_count_distinct(F.xxhash64("line"))).first()[0]
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_LINE * lines - 1).bit_length()))


class Known:
    """Confirmed keys with their first documents, packed and sorted."""

    def __init__(self, table: pa.Table):
        halves = np.frombuffer(b"".join(table.column("key").to_pylist()), "<u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        self.a, self.b = halves[order, 0].copy(), halves[order, 1].copy()
        ids, rows = table.column("doc_id").combine_chunks(), table.column("row").combine_chunks()
        self.null = np.asarray(ids.is_null())[order]
        self.ids, self.rows = (np.asarray(x.fill_null(0))[order] for x in (ids, rows))

    def find(self, keys: list[bytes]) -> dict[bytes, tuple]:
        """Those of the keys that are known, with their first document (id, row)."""
        if not keys or not len(self.a):
            return {}
        halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        found = {}
        lo, hi = np.searchsorted(self.a, halves[:, 0]), np.searchsorted(self.a, halves[:, 0], "right")
        for k in np.flatnonzero(hi > lo):
            for at in range(lo[k], hi[k]):
                if self.b[at] == halves[k, 1]:
                    found[keys[k]] = (None if self.null[at] else int(self.ids[at]), int(self.rows[at]))
        return found


def twice_filter(docs: DataFrame, min_chars: int = 1, filter_bits: int | None = None) -> np.ndarray:
    """Bits (packed) that hold every key which two documents have, and few others."""
    filter_bits = filter_bits or bits_for(docs)
    segments = max(1, filter_bits // SEGMENT_BITS)
    size = filter_bits // segments

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(filter_bits, bool), np.zeros(filter_bits, bool)
        held: list[bytes] = []

        def add() -> None:
            # a key's places count as seen again if all of them were seen before, or if it is twice among these
            keys, times = np.unique(np.frombuffer(b"".join(held), "V16"), return_counts=True)
            at = _probes([keys.tobytes()], filter_bits)
            again = once[at].all(axis=1) | (times > 1)
            twice[at[again].ravel()] = True
            once[at.ravel()] = True
            held.clear()

        for _, text in _texts(batches):
            held.extend({k for k in keys_of(text, min_chars) if k is not None})
            if len(held) >= 200_000:
                add()
        if held:
            add()
        rows = [(s, *(zlib.compress(np.packbits(f[s * size : (s + 1) * size]).tobytes(), 1) for f in (once, twice))) for s in range(segments) if once[s * size : (s + 1) * size].any()]
        yield pa.RecordBatch.from_pylist([{"segment": s, "once": a, "twice": b} for s, a, b in rows], schema=pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, *pair in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in pair)
                if s in held:
                    twice = held[s][1] | twice | (held[s][0] & once)
                    once = held[s][0] | once
                held[s] = [once, twice]
        rows = [{"segment": s, "once": zlib.compress(a.tobytes(), 1), "twice": zlib.compress(b.tobytes(), 1)} for s, (a, b) in held.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    kind = "segment int, once binary, twice binary"
    marked = _slim(docs).mapInArrow(mark, kind)
    merged = marked.repartition("segment").mapInArrow(merge, kind)  # streams, and holds one pair of filters a segment
    out = np.zeros(filter_bits // 8, np.uint8)
    for r in merged.select("segment", "twice").collect():  # filter_bits / 8 bytes in all, whatever the corpus
        out[r.segment * size // 8 : (r.segment + 1) * size // 8] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return out


def _suspected(keys: list[bytes], packed: np.ndarray, bits: int) -> np.ndarray:
    at = _probes(keys, bits)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def repeated_keys(docs: DataFrame, min_docs: int, min_chars: int = 1, filter_bits: int | None = None, with_first: bool = False) -> DataFrame:
    """key (binary), n_docs and first (its first document: id, then hash of its text; null unless asked for) of the
    keys that min_docs documents have.

    Only suspects leave their task; equal keys are counted where they are read before they are dealt out."""
    filter_bits = filter_bits or bits_for(docs)
    packed: Broadcast = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, min_chars, filter_bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, found = [], [], []
            for doc_id, text in _texts([batch]):
                own = list({k for k in keys_of(text, min_chars) if k is not None})
                if own:
                    own = [k for k, yes in zip(own, _suspected(own, packed.value, filter_bits), strict=True) if yes]
                    found += own
                    ids += [doc_id] * len(own)
                    rows += [xxhash.xxh3_64_intdigest(text) - 2**63] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], names=["key", "doc_id", "row"])

    found = _slim(docs).mapInArrow(suspects, "key binary, doc_id bigint, row bigint")
    totals = [F.count(F.lit(1)).alias("n_docs"), *[F.min(F.struct("doc_id", "row")).alias("first")] * with_first]
    counted = found.groupBy("key").agg(*totals)
    if not with_first:
        counted = counted.withColumn("first", F.lit(None).cast("struct<doc_id:bigint,row:bigint>"))
    return counted.where(F.col("n_docs") >= min_docs)


def _drop(text: bytes, doc_id: int | None, bad: dict[bytes, tuple], keep: str, min_chars: int) -> tuple[int, int, bytes]:
    """Lines, dropped lines, and the text of the others. bad: key to its first document (id, row)."""
    lines, keys = text.split(b"\n"), keys_of(text, min_chars)
    stays, kept_once, row = [], set(), None
    for line, key in zip(lines, keys, strict=True):
        if key is None or key not in bad:
            stays.append(line)
        elif keep == "first" and key not in kept_once:
            row = xxhash.xxh3_64_intdigest(text) - 2**63 if row is None else row
            if bad[key] == (doc_id, row):
                kept_once.add(key)
                stays.append(line)
    return len(lines), len(lines) - len(stays), b"\n".join(stays)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", filter_bits: int | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Columns LINES, a row for each row of docs: lines before, lines dropped, the text that stays.

    Confirmed keys number at most lines / min_docs. Up to most_broadcast of them (their number is measured) are sent to
    the tasks; more are joined to the documents' lines and gathered by document."""
    if keep not in ("none", "first"):
        raise ValueError(keep)
    bad = settle(repeated_keys(docs, min_docs, min_chars, filter_bits, keep == "first"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    if bad.count() <= most_broadcast:
        known = docs.sparkSession.sparkContext.broadcast(Known(bad.select("key", "first.doc_id", "first.row").toArrow()))  # at most most_broadcast keys

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_bytes(batches):
                texts, rows = list(_texts([batch])), []
                own = known.value.find(list({k for _, text in texts for k in keys_of(text, min_chars) if k is not None}))
                for doc_id, text in texts:
                    n, dropped, kept = _drop(text, doc_id, own, keep, min_chars)
                    rows.append((doc_id, n, dropped, kept.decode()))
                yield out(rows)

        return _slim(docs).mapInArrow(apply, LINES)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, xxhash.xxh3_64_intdigest(text) - 2**63, k) for doc_id, text in _texts([batch]) for k in {k for k in keys_of(text, min_chars) if k is not None}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "row", "key"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([xxhash.xxh3_64_intdigest(t) - 2**63 for _, t in _texts([batch])], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=["doc_id", "text", "row"])

    def apply_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (doc_id, text), found in zip(_texts([batch]), batch.column(2).to_pylist(), strict=True):
                own = {x["key"]: tuple((x["first"] or {}).values()) for x in found or []}
                n, dropped, kept = _drop(text, doc_id, own, keep, min_chars)
                rows.append((doc_id, n, dropped, kept.decode()))
            yield out(rows)

    slim = _slim(docs)
    marks = slim.mapInArrow(lines, "doc_id bigint, row bigint, key binary").join(bad.select("key", "first"), "key")
    by_row = marks.groupBy("doc_id", "row").agg(F.collect_set(F.struct("key", "first")).alias("found"))
    whole = slim.mapInArrow(hashed, "doc_id bigint, text binary, row bigint").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.row") == F.col("m.row"))
    return whole.join(by_row.alias("m"), same, "left").select("d.doc_id", "d.text", "m.found").mapInArrow(apply_joined, LINES)
