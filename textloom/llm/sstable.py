"""Token ids as sorted-string-table shards.

Documents stand in ascending order of their identifier, in shards that follow one another. A shard is

    "TLSST001"
    data blocks     entries (varint: key bytes shared with the entry before, further key bytes, ids; the further key bytes; the ids)
    block index     for each block: its last key, offset, length, entries, ids in the shard before it
    Bloom filter    of all keys
    footer          offset and length of index and filter, entries, ids, bytes of an id, crc32 of index and filter, "TLSSTEND"

so a lookup asks the filter, searches the index by bisection, and reads one block. The manifest lists the shards in order
with their first and last keys and the ids before each; only the files that it names count.

Recovery: a task writes a file with a name of its own and tells that name when it has ended; a task that is run again writes another
file. The driver writes the manifest last, from the tasks that Spark counts, and then deletes shards that it doesn't name, and nothing else.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from .common import map_batches, quote_columns
from .tokenizing import load_tokenizer, word_encoder

MAGIC, END = b"TLSST001", b"TLSSTEND"
FOOTER = struct.Struct("<QQQQQQBI8s")
BLOCK_BYTES, BITS_PER_KEY, PROBES = 64 << 10, 10, 7
MANIFEST = "MANIFEST.json"
#: Names of shards; no other file in the folder is ever deleted.
OWN_NAME = re.compile("shard-[0-9a-f]{32}\\.sst")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of an absolute path; file:, hdfs:, s3: and gs: work on executors."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def key_bytes(key: int | str | None) -> bytes:
    """Bytes that sort as Spark sorts keys: null, then integers by value, or strings by code point."""
    if key is None:
        return b"\0"
    return b"\1" + struct.pack(">Q", key + (1 << 63)) if isinstance(key, int) else b"\2" + key.encode()


def key_value(raw: bytes) -> int | str | None:
    if raw[0] == 0:
        return None
    return struct.unpack(">Q", raw[1:])[0] - (1 << 63) if raw[0] == 1 else raw[1:].decode()


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
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, hashes: list[int] | None = None, bits: np.ndarray | None = None):
        self.bits = bits if bits is not None else np.zeros(max(64, len(hashes) * BITS_PER_KEY) // 8 + 1, np.uint8)
        for h in hashes or ():
            for p in self._places(h):
                self.bits[p >> 3] |= 1 << (p & 7)

    def _places(self, h: int) -> list[int]:
        a, b, m = h & (1 << 64) - 1, h >> 64 | 1, len(self.bits) * 8
        return [(a + i * b) % m for i in range(PROBES)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(xxhash.xxh3_128_intdigest(key)))


class ShardWriter:
    """Writes entries in key order; holds one block, the index and the keys' hashes."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = out.write(MAGIC)
        self.block, self.last, self.entries, self.ids, self.before, self.in_block = bytearray(), b"", 0, 0, 0, 0
        self.index, self.hashes, self.first = [], [], None

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first = key
        elif key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids.astype(f"<u{self.width}").tobytes()
        self.last, self.in_block = key, self.in_block + 1
        self.hashes.append(xxhash.xxh3_128_intdigest(key))
        self.entries += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            self.index.append([self.last.hex(), self.at, len(self.block), self.in_block, self.before])
            self.at += self.out.write(bytes(self.block))
            self.block, self.before, self.in_block = bytearray(), self.ids, 0

    def close(self) -> dict:
        self._end_block()
        index, bloom = json.dumps(self.index).encode(), Bloom(self.hashes).bits.tobytes()
        crc = zlib.crc32(bloom, zlib.crc32(index))
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, self.width, crc, END))
        return {"first": (self.first or b"").hex(), "last": self.last.hex(), "entries": self.entries, "ids": self.ids}


class Shard:
    """Reads one shard: block by block, or one key."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        raw = self.file.read_at(FOOTER.size, size - FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.entries, self.ids, self.width, crc, end = FOOTER.unpack(raw)
        index, bloom = self.file.read_at(index_len, index_at), self.file.read_at(bloom_len, bloom_at)
        if end != END or zlib.crc32(bloom, zlib.crc32(index)) != crc or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no whole shard")
        self.index, self.bloom = json.loads(index), Bloom(bits=np.frombuffer(bloom, np.uint8))
        self.lasts = [bytes.fromhex(x[0]) for x in self.index]

    def block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids in the shard before it, ids) of the entries of a block."""
        _, offset, length, _, before = self.index[k]
        data, at, key = self.file.read_at(length, offset), 0, b""
        while at < length:
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            ids = np.frombuffer(data, f"<u{self.width}", n, at)
            at += n * self.width
            yield key, before, ids
            before += n

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def lookup(self, key: bytes) -> list[tuple[int, np.ndarray]]:
        """(ids in the shard before it, ids) of every entry with this key, by bisection of the index."""
        if key not in self.bloom:
            return []
        out = []
        for k in range(bisect_left(self.lasts, key), len(self.index)):
            found = [(before, ids) for x, before, ids in self.block(k) if x == key]
            out += found
            if self.lasts[k] > key:
                break
        return out


def write_token_shards(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of ``id_col``; returns the manifest.

    One shuffle: a range partitioning of the texts by identifier, then by the text's hash, so that an identifier of very many rows
    (null too) is dealt over several shards; a sort within partitions, which spills; then each task encodes and writes its shard
    block by block. The driver gets one row for each shard.

    A null text counts as empty (the end id alone); null identifiers come first; rows that repeat an identifier stand side by side,
    ordered by the hash of their text; an empty table gives a manifest without shards; further columns are ignored. Identifiers must be integers or strings.
    """
    if not isinstance(docs.schema[id_col].dataType, (IntegralType, StringType)):
        raise ValueError(f"identifiers must be integers or strings, not {docs.schema[id_col].dataType.simpleString()}")
    width = 2 if max(load_tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, out, name = word_encoder(tokenizer_path), None, None, f"shard-{uuid.uuid4().hex}.sst"
        fs, root = file_system(folder)
        for b in batches:
            if not len(b):
                continue
            if writer is None:
                out = fs.open_output_stream(f"{root}/{name}")
                writer = ShardWriter(out, width)
            for key, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                writer.add(key_bytes(key), np.append(np.frombuffer(ids, "<u4"), end_id))
        if writer is not None:
            about = writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "name": name, **about}])

    d = docs.select(*quote_columns(docs, id_col, text_col)).withColumn("_h", F.xxhash64(text_col))
    d = d.repartitionByRange(F.col(id_col).asc_nulls_first(), "_h").sortWithinPartitions(F.col(id_col).asc_nulls_first(), "_h").select(id_col, text_col)
    shards = map_batches(d, run, "part long, name string, first string, last string, entries long, ids long").collect()
    shards = sorted((r.asDict() for r in shards), key=lambda r: r["part"])  # ranges ascend by partition
    base = 0
    for s in shards:
        s["base"], base = base, base + s["ids"]
    manifest = {"tokenizer": tokenizer_path.rpartition("/")[2], "end_id": end_id, "width": width, "ids": base, "shards": shards}
    with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps(manifest).encode())
    named = {s["name"] for s in shards}
    for x in fs.get_file_info(pafs.FileSelector(root)):
        if x.type == pafs.FileType.File and OWN_NAME.fullmatch(x.base_name) and x.base_name not in named:
            fs.delete_file(x.path)
    return manifest


def read_manifest(folder: str) -> dict:
    fs, root = file_system(folder)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_token_shards(spark: SparkSession, folder: str, *, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, ``ids``. A task for each shard."""
    shards = read_manifest(folder)["shards"]
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not shards:
        return spark.createDataFrame([], schema)

    kind = pa.string() if id_type == "string" else pa.int64()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:4])] + [pa.array(c, pa.list_(pa.int64())) for c in cols[4:]]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard, rows, held = Shard(f"{folder.rstrip('/')}/{name}"), [], 0
                for key, before, ids in shard:
                    rows.append((key_value(key), base + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] * with_ids)))
                    held += len(ids) * with_ids
                    if len(rows) >= 10_000 or held > 1 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    listed = spark.createDataFrame([(i, s["name"], s["base"]) for i, s in enumerate(shards)], "i int, name string, base long")
    return map_batches(listed.repartitionById(len(shards), F.col("i")).select("name", "base"), run, schema)


def lookup_ids(folder: str, key: int | str | None) -> list[list[int]]:
    """The ids of every document with this identifier: bisection over the shards' key ranges, then in each shard."""
    raw, out = key_bytes(key), []
    shards = read_manifest(folder)["shards"]
    for s in shards[bisect_left([bytes.fromhex(s["last"]) for s in shards], raw) :]:
        if bytes.fromhex(s["first"]) > raw:
            break
        out += [ids.tolist() for _, ids in Shard(f"{folder.rstrip('/')}/{s['name']}").lookup(raw)]
    return out
