"""Token ids in sorted-string-table shards.

A shard is one file: data blocks, a sparse block index, a Bloom filter over its keys and a footer. Records are sorted
by key; inside a block each key stores only what differs from the key before it. A reader finds one document with the
filter, a binary search over the block index and one block; a scan reads block after block.

    block   records, zstd-compressed: varint shared key bytes, varint own key bytes, own key bytes,
            varint number of ids, ids as unsigned 32-bit little-endian integers
    index   per block: varint key size, first key, u64 offset, u32 stored bytes, u32 records
    filter  u32 number of bits, bit bytes (7 probes a key)
    footer  u64 index offset, u32 index bytes, u64 filter offset, u32 filter bytes, u64 records, u64 ids, u32 crc32
            of index and filter, 8 bytes MAGIC

Documents are ranged by doc_id over partitions, each partition writes shards of bounded size through pyarrow's
filesystems (so any store that a URI names), and a manifest lists the shards of the attempts that succeeded; files of
lost attempts are named by none. Nulls: a null doc_id has the empty key and sorts first, a null text is empty. Repeated
ids stay, ordered by text. Very long texts are one record. An empty table gives an empty manifest and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import Memo, forget, in_bytes, new_path, text_or_empty

MAGIC = b"RDGLSST1"
FOOTER = struct.Struct("<QIQIQQI8s")
PROBES = 7
BLOCK_BYTES = 1 << 18
SHARD_BYTES = 32 << 20
#: Bytes of input that one partition takes, if Spark's setting gives fewer partitions; and the most partitions.
PART_BYTES, MOST_PARTS = 128 << 20, 1 << 16
END_ID = 1

MANIFEST = "part int, seq int, path string, first_id bigint, n_docs bigint, n_ids bigint, n_bytes bigint"


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes sorted (key, ids) records to an open binary stream; holds one block and the keys' index."""

    def __init__(self, stream, block_bytes: int = BLOCK_BYTES):
        self.stream, self.block_bytes = stream, block_bytes
        self.block, self.held, self.in_block, self.last, self.first = [], 0, 0, b"", b""
        self.offset, self.index, self.keys, self.n_ids = 0, [], [], 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.in_block and self.held >= self.block_bytes:
            self._flush()
        shared = 0
        if not self.in_block:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        own = key[shared:]
        record = _varint(shared) + _varint(len(own)) + own + _varint(len(ids) // 4) + ids
        self.block.append(record)
        self.held, self.in_block, self.last = self.held + len(record), self.in_block + 1, key
        self.keys.append(key)
        self.n_ids += len(ids) // 4

    def _flush(self) -> None:
        stored = zstandard.ZstdCompressor(level=1).compress(b"".join(self.block))
        self.index.append(_varint(len(self.first)) + self.first + struct.pack("<QII", self.offset, len(stored), self.in_block))
        self.stream.write(stored)
        self.offset += len(stored)
        self.block, self.held, self.in_block = [], 0, 0

    def close(self) -> int:
        """Writes index, filter and footer; returns the file's size."""
        if self.in_block:
            self._flush()
        index = b"".join(self.index)
        bits = max(64, 10 * len(self.keys))
        marks = np.zeros(bits, dtype=bool)
        for key in self.keys:
            marks[_probes(key, bits)] = True
        bloom = struct.pack("<I", bits) + np.packbits(marks).tobytes()
        at = self.offset
        self.stream.write(index)
        self.stream.write(bloom)
        self.stream.write(FOOTER.pack(at, len(index), at + len(index), len(bloom), len(self.keys), self.n_ids, zlib.crc32(index + bloom), MAGIC))
        return at + len(index) + len(bloom) + FOOTER.size


class ShardReader:
    """Reads a shard from a seekable stream of `size` bytes."""

    def __init__(self, stream, size: int):
        self.stream = stream
        footer = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_ids, crc, magic = footer
        index, bloom = self._at(index_at, index_size), self._at(bloom_at, bloom_size)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError("not a whole shard")
        self.bits = struct.unpack("<I", bloom[:4])[0]
        self.marks = np.unpackbits(np.frombuffer(bloom[4:], np.uint8))
        self.firsts, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.firsts.append(index[at : at + n])
            self.blocks.append(struct.unpack_from("<QII", index, at + n))
            at += n + 16

    def _at(self, offset: int, size: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(size)

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        offset, size, count = self.blocks[k]
        data, at, key = zstandard.ZstdDecompressor().decompress(self._at(offset, size)), 0, b""
        for _ in range(count):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            n, at = _read_varint(data, at + own)
            yield key, data[at : at + 4 * n]
            at += 4 * n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self._block(k)

    def may_hold(self, key: bytes) -> bool:
        return bool(self.marks[_probes(key, self.bits)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each record of doc_id; none if it isn't here."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        found, k = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.blocks) and self.firsts[k] <= key:
            found += [np.frombuffer(ids, "<u4") for at, ids in self._block(k) if at == key]
            k += 1
        return found


#: Texts of these characters alone fall into pieces in a way that needs no library call: no apostrophe (contractions),
#: no "<" (control tokens), no combining mark, nothing whose lower case depends on its neighbours.
_SIMPLE = re.compile(r"[ \n\t\r!-&(-;=-~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _memos(tokenizer_path: str) -> tuple[Memo, Memo]:
    """Ids as bytes, by lower-cased piece and by stretch of text without spaces or line ends."""
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(tokenizer_path), _byte_letters()
    model = tokenizer.model

    def piece(p: str) -> bytes:
        shown = p if p.isascii() else "".join(letters[b] for b in p.encode())
        return np.asarray([t.id for t in model.tokenize(shown)], "<u4").tobytes()

    def stretch(s: str) -> bytes:
        if _SIMPLE.fullmatch(s):
            return b"".join([pieces[p] for p in _PIECE.findall(s.lower())])
        return np.asarray(tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    pieces = Memo(piece, 250_000)
    return pieces, Memo(stretch, 50_000)


def encode(text: str, tokenizer_path: str) -> bytes:
    """The text's ids and END_ID, as encode() of the library gives them for this lower-casing word tokenizer.

    It drops white space and no id spans it, so a text's ids are those of its stretches one behind the other, and
    stretches of plain letters, digits and marks are those of their pieces, which recur. Tested against whole texts."""
    pieces, stretches = _memos(tokenizer_path)
    if _SIMPLE.fullmatch(text):
        ids = [pieces[p] for p in _PIECE.findall(text.lower())]
    else:
        ids = [stretches[w] for w in text.replace("\n", " ").split(" ") if w]
    ids.append(struct.pack("<I", END_ID))
    return b"".join(ids)


def open_uri(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, shard_bytes: int = SHARD_BYTES, partitions: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) into shards under folder and returns the manifest (columns MANIFEST), which is
    computed here and kept in the shared folder. Shards are in key order by (part, seq)."""
    spark = docs.sparkSession
    folder = (folder or new_path(spark, "shards")).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_uri(folder)
        fs.create_dir(root, recursive=True)
        part, attempt, rows = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], []
        writer = name = first = None
        forget(*_memos(tokenizer_path))  # pieces recur from task to task

        def close():
            size = writer.close()
            writer.stream.close()
            rows.append((part, len(rows), f"{folder}/{name}", first, len(writer.keys), writer.n_ids, size))

        for batch in in_bytes(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer and writer.offset + writer.held >= shard_bytes:
                    close()
                    writer = None
                if writer is None:
                    name, first = f"{part:06d}-{len(rows):05d}-{attempt}.sst", doc_id
                    writer = ShardWriter(fs.open_output_stream(f"{root}/{name}"))
                writer.add(key_of(doc_id), encode(text, tokenizer_path))
        if writer:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(_names(), r, strict=True)) for r in rows], schema=_manifest_schema())

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, _input_bytes(docs) // PART_BYTES))
    # an id that very many rows have is split by how its texts begin, in the order that they are written in
    ranged = slim.repartitionByRange(n, "doc_id", F.substring("text", 1, 24))
    manifest = ranged.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)
    at = new_path(spark, "manifest")
    manifest.write.parquet(at)
    return spark.read.schema(MANIFEST).parquet(at)


def _input_bytes(docs: DataFrame) -> int:
    """Bytes that Spark takes docs to have (for files, their size); 0 where it says that it doesn't know."""
    said = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return said if said < 1 << 60 else 0


def _names() -> list[str]:
    return [x.split()[0] for x in MANIFEST.split(", ")]


def _manifest_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in MANIFEST.split(", ")])


def shard_starts(manifest: DataFrame) -> DataFrame:
    """path, n_bytes, start (ids in all shards before it), n_docs. Shards are added up within their part; only one row a
    part meets in one task."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("ids").over(before("part")), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("part", "path", "n_bytes", "n_docs", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    return shards.join(bases, "part").select("path", "n_bytes", (F.col("base") + F.col("inside")).alias("start"), "n_docs")


def read_shards(manifest: DataFrame) -> DataFrame:
    """From the shards a manifest lists: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. A task streams
    its shards block by block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, name = open_uri(path)
                out: list[list] = [[], [], [], []]
                with fs.open_input_file(name) as stream:
                    for key, ids in ShardReader(stream, size).scan():
                        for column, value in zip(out, (id_of(key), start, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            column.append(value)
                        start += len(ids) // 4
                        if len(out[0]) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
                            out = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    listed = shard_starts(manifest).select("path", "n_bytes", "start")
    n = max(manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(n).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids stored for one document: only shards whose range can hold it are opened."""
    rows = sorted(manifest.collect(), key=lambda r: (r.part, r.seq))
    firsts, found = [key_of(r.first_id) for r in rows], []
    k, key = max(0, bisect.bisect_left(firsts, key_of(doc_id)) - 1), key_of(doc_id)
    while k < len(rows) and firsts[k] <= key:
        fs, name = open_uri(rows[k].path)
        with fs.open_input_file(name) as stream:
            found += ShardReader(stream, rows[k].n_bytes).get(doc_id)
        k += 1
    return found
