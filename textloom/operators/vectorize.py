"""TF-IDF in long form (one row for each document and term) and as sparse vectors.

Vocabulary: the ``max_features`` terms of highest corpus frequency, ties by term; indices in alphabetical order.
Weight: tf * (ln((1 + n) / (1 + df)) + 1), with n all documents, blank ones included; rows have length 1.
Only the vocabulary (at most ``max_features`` rows) ever reaches the driver. Without a limit (``max_features=None``) not even that does: terms are numbered over
ranges, and the vocabulary stays a table. Rows come in packets of bounded size; a packet asks once for each of its terms, so what meets the vocabulary are the packets' terms, not the rows'.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.stopwords import ENGLISH
from ..functions.text import coerce_text, tokens, without_stop_words
from ..storage import materialize, spread
from .entries import parts as _parts
from .labels import numbered


#: Rows of a batch of results, and words that are counted at once.
OUT_ROWS, WORDS = 200_000, 500_000
#: Times a core's share that a piece of the input may have before the texts are dealt anew.
MOST = 2
EMPTY = "empty vocabulary: the texts have no term besides stop words and single characters"


class EmptyVocabularyError(ValueError):
    """No term is left to cluster by."""


def token_table(docs: DataFrame, text: str, row_id: str, stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """``row_id``, ``words``: tokens less stop words. White space at the ends of a text stands in no token, so it isn't taken off first."""
    return docs.select(F.col(f"`{row_id}`").alias("row_id"), without_stop_words(tokens(coerce_text(F.col(f"`{text}`"))), stop_words).alias("words"))


def _cells(lists: pa.Array, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and number of all codes (below ``n``, or negative for none) of a column of lists, by row and code."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    some = codes >= 0
    cells, tf = np.unique(row[some] * max(1, n) + codes[some], return_counts=True)
    return cells // max(1, n), cells % max(1, n), tf.astype(np.int64)


def term_frequency(words: DataFrame) -> DataFrame:
    """``row_id``, ``term``, ``tf``; a row's words are in one place, so they are counted there and nothing is shuffled. ``row_id`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in _parts(batch, WORDS)):
            known = b.column(1).flatten().dictionary_encode()
            row, code, tf = _cells(b.column(1), known.indices.to_numpy(zero_copy_only=False), len(known.dictionary))
            for i in range(0, len(row), OUT_ROWS):
                here = slice(i, i + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[here])), known.dictionary.take(pa.array(code[here])), pa.array(tf[here])], ["row_id", "term", "tf"])

    kind = StructType([words.schema["row_id"], StructField("term", StringType(), False), StructField("tf", LongType(), False)])
    return words.select("row_id", "words").mapInArrow(run, kind)


def word_statistics(words: DataFrame) -> DataFrame:
    """``term``, ``cf`` (all occurrences) and ``df`` (documents), combined in each map task, so what is shuffled is one row for each term and task."""
    return term_frequency(words).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def in_packets(words: DataFrame) -> DataFrame:
    """``row_id``, ``words`` and ``packet``: rows that come as one batch, whose rows and bytes are bounded, have the same number. To be written before it is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), (part << 32) + i))], ["row_id", "words", "packet"])

    return words.select("row_id", "words").mapInArrow(run, StructType([*words.select("row_id", "words").schema, StructField("packet", LongType())]))


def vocabulary(stats: DataFrame, max_features: int) -> DataFrame:
    """``term``, ``term_idx``, ``cf``, ``df``; at most ``max_features`` rows, so one window partition holds them."""
    top = stats.orderBy(F.desc("cf"), "term").limit(max_features)
    return top.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("term_idx"), "cf", "df")


def idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    return vocab.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)


@dataclass(frozen=True)
class VectorizerModel:
    """A fitted vocabulary: terms in index order, their idf, and the documents seen."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    cf: tuple[int, ...]
    df: tuple[int, ...]
    n_docs: int
    stop_words: tuple[str, ...] = ENGLISH

    @property
    def n_terms(self) -> int:
        return len(self.terms)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, c, d, w) for i, (t, c, d, w) in enumerate(zip(self.terms, self.cf, self.df, self.idf, strict=True))]
        return spark.createDataFrame(rows, "term string, term_idx int, cf long, df long, idf double")

    def _scaled(self, words: DataFrame) -> DataFrame:
        count = CountVectorizerModel.from_vocabulary(list(self.terms), "words", "tf")
        scale = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="tf", outputCol="weighted")
        return Normalizer(p=2.0, inputCol="weighted", outputCol="features").transform(scale.transform(count.transform(words)))

    def long_form(self, words: DataFrame) -> DataFrame:
        """``row_id``, ``term``, ``term_idx``, ``tf``, ``weight`` and ``unit`` (weight over the row's length); no shuffle.

        The vocabulary has a fixed bound and is broadcast.
        """
        tf, weighted, unit = (F.unwrap_udt(c) for c in ("tf", "weighted", "features"))
        each = F.explode(F.arrays_zip(tf["indices"].alias("term_idx"), tf["values"].alias("tf"), weighted["values"].alias("weight"), unit["values"].alias("unit")))
        rows = self._scaled(words).select("row_id", each.alias("x")).select("row_id", "x.term_idx", F.col("x.tf").cast("long").alias("tf"), "x.weight", "x.unit")
        return rows.join(F.broadcast(self.table(words.sparkSession).select("term_idx", "term")), "term_idx").select("row_id", "term", "term_idx", "tf", "weight", "unit")

    def vectors(self, words: DataFrame) -> DataFrame:
        """``row_id``, ``features``: sparse unit vectors, zero for rows without a term; no shuffle."""
        return self._scaled(words).select("row_id", "features")


@dataclass(frozen=True)
class TableModel:
    """A fitted vocabulary without a limit, as a table (term, term_idx, cf, df, idf) in the shared folder."""

    vocabulary: DataFrame
    n_terms: int
    n_docs: int
    stop_words: tuple[str, ...] = ENGLISH

    def table(self, spark: SparkSession) -> DataFrame:
        return self.vocabulary

    def _weighted(self, words: DataFrame, long: bool) -> DataFrame:
        """The rows of each packet with the numbers and weights of its terms, in long form or as vectors. Each packet's terms meet the vocabulary once, and come back to its rows."""
        words = words if "packet" in words.columns else materialize(in_packets(words), "words")

        def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packets = b.column(1).to_numpy()
                for k in np.unique(packets):
                    some = b.column(0).filter(pa.array(packets == k)).flatten().unique()
                    for i in range(0, len(some), OUT_ROWS):
                        part = some.slice(i, OUT_ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k)), part], ["packet", "term"])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows, known = left.combine_chunks(), right.sort_by("term_idx").combine_chunks()
            lists = rows.column("words").chunk(0) if len(rows) else pa.array([], rows.schema.field("words").type)
            index, idf = known.column("term_idx").to_numpy(), known.column("idf").to_numpy()
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=known.column("term")), -1).to_numpy(zero_copy_only=False)
            row, at, tf = _cells(lists, code, len(index))
            weight = tf * idf[at]
            unit = weight / np.sqrt(np.bincount(row, weight * weight, len(rows)))[row]
            if long:
                return pa.table([rows.column("row_id").take(pa.array(row)), known.column("term").take(pa.array(at)), pa.array(index[at]), pa.array(tf), pa.array(weight), pa.array(unit)], ["row_id", "term", "term_idx", "tf", "weight", "unit"])
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(rows)))).astype(np.int32))
            return pa.table([rows.column("row_id"), pa.ListArray.from_arrays(ends, pa.array(index[at])), pa.ListArray.from_arrays(ends, pa.array(unit))], ["row_id", "t", "w"])

        numbers = [StructField("term", StringType()), StructField("term_idx", IntegerType()), StructField("tf", LongType()), StructField("weight", DoubleType()), StructField("unit", DoubleType())]
        kind = StructType([words.schema["row_id"], *(numbers if long else [StructField("t", ArrayType(IntegerType())), StructField("w", ArrayType(DoubleType()))])])
        asked = words.select("words", "packet").mapInArrow(terms, "packet long, term string").join(self.vocabulary.select("term", "term_idx", "idf"), "term")
        return words.groupBy("packet").cogroup(asked.groupBy("packet")).applyInArrow(run, kind)

    def long_form(self, words: DataFrame) -> DataFrame:
        """As :meth:`VectorizerModel.long_form`."""
        return self._weighted(words, True)

    def vectors(self, words: DataFrame) -> DataFrame:
        """``row_id``, ``t``, ``w``: places and values of unit vectors, both empty for rows without a term."""
        return self._weighted(words, False)


@dataclass(frozen=True)
class TextVectorizer:
    """Fits a :class:`VectorizerModel`, or a :class:`TableModel` if ``max_features`` is None."""

    max_features: int | None = 2000
    stop_words: tuple[str, ...] = ENGLISH

    def fit(self, words: DataFrame) -> VectorizerModel | TableModel:
        """From the words of all documents (row_id, words), as :func:`token_table` gives them."""
        n = words.count()
        if self.max_features is None:
            terms = materialize(idf(numbered(word_statistics(words), "term", "term_idx"), n).select("term", "term_idx", "cf", "df", "idf"), "vocabulary")
            if n_terms := terms.count():
                return TableModel(terms, n_terms, n, self.stop_words)
            raise EmptyVocabularyError(EMPTY)
        rows = vocabulary(word_statistics(words), self.max_features).transform(lambda v: idf(v, n)).orderBy("term_idx").collect()
        if not rows:
            raise EmptyVocabularyError(EMPTY)
        return VectorizerModel(tuple(r.term for r in rows), tuple(r.idf for r in rows), tuple(r.cf for r in rows), tuple(r.df for r in rows), n, self.stop_words)


@dataclass
class Matrix:
    """The fitted model with its documents' words, kept for the stages that read them again."""

    model: VectorizerModel | TableModel
    words: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, text: str, row_id: str, max_features: int | None = 2000, stop_words: tuple[str, ...] = ENGLISH) -> Matrix:
        words = token_table(spread(docs, MOST), text, row_id, stop_words)
        words = materialize(words if max_features is not None else in_packets(words), "words", "zstd")  # texts are read and cut once
        return cls(TextVectorizer(max_features, stop_words).fit(words), words)

    @cached_property
    def long(self) -> DataFrame:
        return self.model.long_form(self.words)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.model.vectors(self.words).persist(StorageLevel.MEMORY_AND_DISK)

    def shape(self) -> tuple[int, int]:
        return self.model.n_docs, self.model.n_terms

    def unpersist(self) -> None:
        if "vectors" in self.__dict__:
            self.__dict__.pop("vectors").unpersist()
