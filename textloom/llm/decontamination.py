"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (``window`` consecutive words; an item with fewer is one window) are sets of word shingles. A document holds a
window only if it holds all its shingles, so it is enough to join on a prefix of each set: with the shingles ordered by rarity in
the corpus, the prefix for containment of the whole set is its single rarest shingle. A match gives the place where the window would have to
begin (positional bound) and whether it fits into the document (length bound); what passes is verified word by word.

The items' side is small against the documents but not bounded, so it isn't broadcast: documents send only the places
where a prefix shingle may stand, told by a Bloom filter of fixed size, together with the words around it, and an ordinary
join on the shingle's hash finds the windows. Places of one shingle are dealt over ``SALTS`` salts, for which the windows are
repeated, so that a passage in a third of all documents isn't one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, filter_of
from .common import hot_keys, join_hot, map_batches, materialize, mix, quote_columns

#: Lower-cases A-Z; what is no ASCII digit, no ASCII letter and no byte of a character beyond ASCII parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MEMO_ENTRIES = 500_000
WINDOW, SHINGLE, SALTS = 10, 3, 8
#: Windows' words are parted by a byte that no word has.
SEP = b" "


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: A-Z lower-cased, then runs of word characters."""
    return text.encode().translate(FOLD).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[list[bytes]]:
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


class WordHashes(dict):
    """Hashes of words, kept as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: Iterator[bytes], n: int) -> np.ndarray:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles that begin at each word, from the words' hashes."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out) + words[i : i + n]
    return mix(out).view(np.int64)


class Prober:
    """Finds the places in documents whose shingle a filter may have, for all texts of a batch at once.

    ``sizes`` are the shingles' lengths: items shorter than a shingle have shorter ones.
    """

    def __init__(self, bits: bytes, sizes: list[int]):
        self.filter, self.sizes, self.hashes = Bloom(bits), sizes, WordHashes()

    def places(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, hash) of prefix shingles in texts that are split into words."""
        counts = np.array([len(w) for w in texts], np.int64)
        ends = np.cumsum(counts)
        words = self.hashes.of(chain.from_iterable(texts), int(counts.sum()))
        found = []
        for k in self.sizes:
            h = shingle_hashes(words, k)
            at = np.flatnonzero(self.filter.has(h))
            text = np.searchsorted(ends, at, "right")
            inside = at + k <= ends[text]  # else it runs into the next text
            found.append((text[inside], (at - ends[text] + counts[text])[inside], h[at[inside]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``id_col``, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items``, ``items`` (sorted as strings) and ``contaminated``.

    Defined results: null or empty texts have no words and no hits; items without words have no window; items that repeat an
    identifier count once, with the windows of all their rows; a null item identifier is left out of ``items``, its words still count as hit; documents are told
    apart by their text alone, so repeated rows each get the same row; empty tables give no hits; further columns are ignored.
    """
    rows = items.select(items[item_col].cast("string").alias("item"), items[item_text_col].alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = min(window, len(words))
                k = min(shingle, n)
                h = shingle_hashes(hashes.of(iter(words), len(words)), k).tolist()
                for i, w in enumerate(windows_of(words, window)):
                    out.append((item, SEP.join(w), n, [{"h": x, "o": o} for o, x in enumerate(h[i : i + n - k + 1])]))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.binary(), pa.int32(), pa.list_(pa.struct([("h", pa.int64()), ("o", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item", "w", "n", "shingles"])

    cuts = materialize(map_batches(rows, cut, "item string, w binary, n int, shingles array<struct<h:long,o:int>>"), "windows")
    owners = cuts.select("w", "item").distinct()
    windows = cuts.groupBy("w", "n").agg(F.first("shingles").alias("shingles"))
    known = windows.select("w", "n", F.explode("shingles").alias("s")).select("w", "n", "s.h", "s.o")

    sizes = sorted(r[0] for r in cuts.select(F.least("n", F.lit(shingle))).distinct().collect())  # at most ``shingle`` numbers

    # rarity: in how many places of the corpus each of the items' shingles stands
    docs2 = docs.select(*quote_columns(docs, id_col, text_col))
    all_bits = filter_of(known.select("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = Prober(all_bits, sizes)
        for b in batches:
            _, _, found = prober.places([words_of(t) for t in b.column(0).to_pylist()])
            h, places = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(places, pa.int64())], ["h", "places"])

    rarity = map_batches(docs2.select(text_col), count, "h long, places long").groupBy("h").agg(F.sum("places").alias("places"))
    prefix = known.join(rarity, "h", "left").groupBy("w", "n").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), F.col("h"), F.col("o"))).alias("p"))
    # a window of which some shingle stands nowhere can't occur
    prefix = materialize(prefix.where(F.col("p.places") > 0).select("w", "n", "p.h", "p.o"), "prefix")
    bits = filter_of(prefix.select("h"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = Prober(bits, sizes)
        kind = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]))
        for b in batches:
            texts = [words_of(t) for t in b.column(1).to_pylist()]
            n_words, found = [len(w) for w in texts], [[] for _ in texts]
            for i, p, h in zip(*(x.tolist() for x in prober.places(texts)), strict=True):
                found[i].append({"h": h, "p": p, "left": SEP.join(texts[i][max(0, p - window + 1) : p]), "right": SEP.join(texts[i][p : p + window])})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n_words, pa.int64()), pa.array(found, kind)], [id_col, "_key", "n_words", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs2.select(id_col, text_col, F.md5(F.coalesce(text_col, F.lit(""))).alias("_key"))
    probed = materialize(map_batches(keyed, probe, f"`{id_col}` {kind}, _key string, n_words long, found array<struct<h:long,p:int,left:binary,right:binary>>"), "places")

    # copies of a text find the same places: one of each is enough
    at = probed.where(F.size("found") > 0).select("_key", F.explode("found").alias("f")).select("_key", "f.*").groupBy("_key", "h", "p").agg(F.first("left").alias("left"), F.first("right").alias("right"))
    at = at.withColumn("_salt", F.pmod(F.xxhash64("_key", "p"), F.lit(SALTS)).cast("int"))
    salted = prefix.select("w", "n", "h", "o", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    left, right, w = (F.col(c).cast("string") for c in ("left", "right", "w"))
    left, right = F.array_remove(F.split(left, " "), ""), F.array_remove(F.split(right, " "), "")
    fits = (F.col("p") >= F.col("o")) & (F.size(left) >= F.col("o")) & (F.size(right) >= F.col("n") - F.col("o"))  # positional and length bounds
    there = F.array_join(F.concat(F.slice(left, F.size(left) - F.col("o") + 1, F.col("o")), F.slice(right, F.lit(1), F.col("n") - F.col("o"))), " ") == w
    hits = at.join(salted, ["h", "_salt"]).where(F.when(fits, there).otherwise(False)).select("_key", "_salt", (F.col("p") - F.col("o")).alias("start"), "n", "w")
    hits = materialize(hits, "hits")

    # words inside: sorted starts of a document, each adding what the ends before it don't cover
    spans = hits.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))
    covered = F.aggregate("s", zero, lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).alias("sum"), F.greatest(a["end"], x["end"]).alias("end")), lambda a: a["sum"])
    n_hit = spans.select("_key", covered.alias("n_hit"))
    owners = owners.where(F.col("item").isNotNull()).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a common passage is one window in very many texts
    named = hits.select("_key", "_salt", "w").distinct().join(owners, ["w", "_salt"]).groupBy("_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per_text = n_hit.join(named, "_key", "left")
    none = F.lit(0).cast("long")
    # rows without a place have no hits; of the others, copies of one text may be very many
    some, rest = probed.where(F.size("found") > 0).select(id_col, "_key", "n_words"), probed.where(F.size("found") == 0)
    counts = some.groupBy("_key").agg(F.count("*").alias("copies"))
    out = join_hot(some, per_text, "_key", hot_keys(counts, "_key", "copies", probed.count()), [id_col, "n_words"]).select(id_col, "n_words", "n_hit", "items")
    out = out.unionByName(rest.select(id_col, "n_words", none.alias("n_hit"), F.lit(None).cast("array<string>").alias("items")))
    return out.select(id_col, "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
