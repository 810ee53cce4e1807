"""BPE encoding and decoding through a distinct-word table.

Words (runs between ASCII white space) are split off in Spark, each distinct word of the whole corpus is encoded once, and the ids
come back to the documents by position; decoding joins ids to their pieces.

The table and the join are packed so that what is shuffled stays near the size of the texts:

1. documents are dealt to chunks of bounded bytes by the hash of the row and of its partition, so that even rows that are equal as a whole part;
2. a chunk lists its distinct words, sorted, and sends them as one packet to each word bucket (the hash of the word): a
   frequent word is one entry per chunk, so no word is hot;
3. a bucket encodes each distinct word once for all chunks, packet by packet, and returns for each packet the ids in the order of its words;
4. a chunk puts the ids back at the positions of its words, joins them to pieces, and joins the pieces of each document.

There are as many chunks as the bytes of the texts ask for, and as many buckets as the number of distinct words asks for: packets grow as their product, so in
proportion to the texts as far as the vocabulary stays the same. Partitions are as many as the session's shuffle setting says at most: a chunk or a bucket is a partition of its own up to there, and beyond
a partition has several, one after another. A task holds one chunk, or the distinct words of one bucket and one packet. Rows that are equal as a whole go to one chunk for each partition that the
table is read in, so a chunk is never larger than such a partition and ``CHUNK_BYTES`` together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, quote_columns, row_key, spark_words
from .tokenizing import check_no_decoder, load_tokenizer, word_encoder

#: Bytes of text in a chunk, about (a longer text is a chunk's larger part), distinct words in a bucket, about, and words that are put together at once.
CHUNK_BYTES, BUCKET_WORDS, SLICE_WORDS = 32 << 20, 1 << 18, 1 << 18


#: Columns of our own, by names that a caller's table won't have.
CHUNK, WORDS = "__chunk_of_words", "__words_of_text"


@cache
def pieces(path: str) -> pa.Array:
    """The id-to-piece relation of a tokenizer, in id order; its size is that of the vocabulary."""
    of = {i: p for p, i in load_tokenizer(path).get_vocab(with_added_tokens=True).items()}
    return pa.array([of.get(i, "") for i in range(max(of, default=-1) + 1)], pa.string())


class ChunkWords:
    """The words of a chunk: ``words`` has the distinct ones sorted by bucket and then by their bytes, ``at`` the place there of each word of the texts."""

    def __init__(self, texts: pa.ChunkedArray, buckets: int):
        lists = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        lists = lists.cast(pa.large_list(pa.large_string()))
        self.counts = pc.list_value_length(lists).to_numpy()
        coded = lists.flatten().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        raw = coded.dictionary.cast(pa.large_binary())
        by_bytes = pc.array_sort_indices(raw).to_numpy()
        raw = raw.take(pa.array(by_bytes))
        bucket = np.fromiter((zlib.crc32(w) for w in raw.to_pylist()), np.uint32, len(raw)) % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        self.words, self.bucket = raw.take(pa.array(order)), bucket[order]
        place = np.empty(len(order), np.int64)
        place[by_bytes[order]] = np.arange(len(order))
        self.at = place[coded.indices.to_numpy()] if len(order) else np.zeros(0, np.int64)

    def packets(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, its words) of the buckets that have any, in order; no word has a line feed."""
        starts = np.flatnonzero(np.diff(self.bucket.astype(np.int64), prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(self.bucket)], strict=True) if len(starts) else ():
            yield int(self.bucket[s]), zstandard.compress(b"\n".join(self.words[s:e].to_pylist()))


def words_in(packet: bytes) -> list[bytes]:
    return zstandard.decompress(packet).split(b"\n")


def pack_ids(each: list[bytes], width: int) -> bytes:
    """Numbers of ids, then the ids at ``width`` bytes; ``each`` has them as unsigned 32-bit integers."""
    counts = np.array([len(x) // 4 for x in each], "<u2" if all(len(x) < 1 << 18 for x in each) else "<u4")
    return zstandard.compress(struct.pack("<IB", len(each), counts.itemsize) + counts.tobytes() + np.frombuffer(b"".join(each), "<u4").astype(f"<u{width}").tobytes())


def unpack_ids(packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids)."""
    packed = zstandard.decompress(packed)
    n, size = struct.unpack_from("<IB", packed)
    return np.frombuffer(packed, f"<u{size}", n, 5).astype(np.int64), np.frombuffer(packed, f"<u{width}", -1, 5 + n * size).astype(np.uint32)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start`` to ``start + count - 1`` of each pair, one range after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def dealt(df: DataFrame, key: str, n: int, partitions: int) -> DataFrame:
    """``df`` by its number ``key`` (below ``n``): a partition for each if there are no more than ``partitions``, else several in one."""
    return df.repartitionById(n, F.col(key)) if n <= partitions else df.repartition(partitions, key)


def packets_of(docs: DataFrame, words: str, chunk: str, buckets: int) -> DataFrame:
    """The packets (``bucket``, ``chunk``, ``words``) of documents that are partitioned by ``chunk``."""

    def send(group: pa.Table) -> pa.Table:
        k = group.column(chunk)[0].as_py()
        packets = [(b, k, w) for b, w in ChunkWords(group.column(words), buckets).packets()]
        return pa.table(list(zip(*packets, strict=True)) or [[], [], []], pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("words", pa.binary())]))

    return docs.groupBy(chunk).applyInArrow(send, "bucket int, chunk int, words binary")


def encode_decode(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_words: int = BUCKET_WORDS, with_content: bool = False, keep: tuple[str, ...] = (), partitions: int | None = None
) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole text; with ``with_content`` also ``ids`` and ``decoded``.

    Ids are those of the tokenizers library without added special tokens; decoding joins the pieces of all ids by spaces, as the library does for
    a tokenizer without decoder; one with a decoder is refused. ``keep`` names columns to carry along. The numbers of chunks and buckets come from the bytes of the table and an
    estimate of its distinct words, that of ``partitions`` from the session's shuffle setting unless it is given; all only lay out the work.

    A null or empty text has no ids and decodes to an empty text; repeated rows each get a row; an empty table gives an
    empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    check_no_decoder(tokenizer_path)
    tok = load_tokenizer(tokenizer_path)
    most = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    width = 2 if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    cols = list(dict.fromkeys([id_col, text_col, *keep]))
    d = docs.select(*quote_columns(docs, *cols))
    text = F.col(f"`{text_col}`")
    n = max(1, -(-(d.agg(F.sum(F.octet_length(text))).first()[0] or 0) // chunk_bytes))
    buckets = max(1, -(-d.select(F.explode(spark_words(text)).alias("w")).agg(F.approx_count_distinct("w", 0.05)).first()[0] // bucket_words)) if n > 1 else 1
    d = dealt(d.withColumn(CHUNK, F.pmod(F.hash(row_key(*[F.col(f"`{c}`") for c in cols]), F.spark_partition_id()), F.lit(n)).cast("int")), CHUNK, n, most)
    fields = [c for c in cols if c != text_col or c in keep]
    d = d.select(*[F.col(f"`{c}`") for c in fields], CHUNK, spark_words(text).alias(WORDS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, bucket = word_encoder(tokenizer_path), {}, -1
        for b in batches:
            for i, own in enumerate(b.column(0).to_pylist()):
                if own != bucket:  # buckets come one after another
                    table, bucket = {}, own
                words = words_in(b.column(2)[i].as_py())
                table |= encoder.encode_words(set(words).difference(table))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, 1), b.column(0).slice(i, 1), pa.array([pack_ids([table[w] for w in words], width)], pa.binary())], [CHUNK, "bucket", "ids"])

    def assemble(group: pa.Table, packets: pa.Table) -> pa.Table:
        chunk = ChunkWords(group.column(WORDS), buckets)
        got = [unpack_ids(x, width) for _, x in sorted(zip(packets.column("bucket").to_pylist(), packets.column("ids").to_pylist(), strict=True))]
        counts, ids = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        if len(counts) != len(chunk.words):
            raise ValueError("the packets of a chunk don't have all its words")
        starts, piece = np.cumsum(counts) - counts, pieces(tokenizer_path)
        ends = np.cumsum(chunk.counts)
        rows, doc = [], 0
        while doc < len(group):
            first = int(ends[doc] - chunk.counts[doc])
            upto = max(doc + 1, int(np.searchsorted(ends, first + SLICE_WORDS, "right")))
            at = chunk.at[first : int(ends[upto - 1])]
            own = ids[ranges(starts[at], counts[at])]  # ids by the positions of the words
            words = np.concatenate([[0], np.cumsum(counts[at])])
            cuts = words[np.concatenate([[0], ends[doc:upto] - first])].tolist()
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), piece.take(pa.array(own))), " ")  # the join of ids and pieces
            raw = memoryview(own.astype("<u4").tobytes())
            for a, b, text in zip(cuts, cuts[1:], decoded.to_pylist(), strict=False):
                row = [b - a, hashlib.sha256(raw[4 * a : 4 * b]).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                rows.append(row + [own[a:b].astype(np.int64).tolist(), text] * with_content)
            doc = upto
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()][: 5 if with_content else 3]
        out = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)]
        return pa.table([*[group.column(c) for c in fields], *out], names=[*fields, *["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(kinds)]])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in fields], "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<long>, decoded string"] * with_content])
    # both groupings take the same columns, so that Spark shuffles the texts once and reuses that exchange
    sent = dealt(packets_of(d, WORDS, CHUNK, buckets), "bucket", buckets, most)
    sent = sent if buckets <= most else sent.sortWithinPartitions("bucket")
    back = dealt(map_batches(sent, encode, f"{CHUNK} int, bucket int, ids binary"), CHUNK, n, most)
    return d.groupBy(CHUNK).cogroup(back.groupBy(CHUNK)).applyInArrow(assemble, schema)
