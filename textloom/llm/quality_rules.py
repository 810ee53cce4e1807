"""Quality rules from cross-document line frequency, in DataFrame functions only.

Method: lines are normalised and hashed; for each host the distinct documents of a line are counted; lines above the
limit are boilerplate and removed; a document of which too little remains is rejected. Beside it stand the
rules on a document alone (word count and repeated three-word windows).

A document is a row; rows that are equal as a whole count as one. So a page that a host serves under very many identifiers turns
its own lines into boilerplate and is rejected with all its copies. Lines of every length take part.

The texts are read once: that pass writes the counts of each row and the hashes of its lines under a row number, and all later steps read that table. Only if the
texts without their frequent lines are asked for, they are read again.

Hot groups: counts are pre-aggregated in each map task, first by (host, line, document) and then by (host, line), so a host or
line with a third of all rows costs one row per map task. The frequent lines are written before they are joined to the rows' lines, so that both sides are plain
shuffles, which adaptive execution may broadcast (below its size limit, with the real size known) or split by skew.

Defined results: null text has no words (base_failed, not kept); a null host is a host of its own; repeated rows each get
their row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, quote_columns, row_key, spark_words

#: The characters that are counted as symbols.
SYMBOLS = "#*$%&|<>"


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, which a lambda over a column expression would not promise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more, the first occurrence included.

    Windows are hashed; sorting (hash, position) puts equal ones side by side, so the cost is n log n for any text.
    """

    def from_sorted(s):
        again = F.filter(s, lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | (F.get(s, j + 1)["h"] == e["h"]))
        starts = F.array_sort(F.transform(again, lambda e: e["i"]))
        return _bind(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(width), F.get(p, k + 1) - x), F.lit(width))), F.lit(0).cast("long"), lambda a, x: a + x))

    def from_hashes(t):
        pairs = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(_bind(pairs, from_sorted))

    def from_words(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(_bind(hashes, from_hashes))

    return _bind(words, from_words)


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) != ""


def normal_lines(text: Column) -> Column:
    """The lines of a text in lower case, digits as 0, white space runs as one space: what still counts as the same boilerplate line; one without a word is empty."""
    plain = F.translate(F.lower(text), "123456789" + SPACE.replace("\n", ""), "0" * 9 + " " * (len(SPACE) - 1))
    return F.transform(F.split(plain, "\n"), lambda x: F.trim(F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x)))


def hashed_line(normal: Column) -> Column:
    """The hash ``h`` of a normalised line (null if it has no word) and its number of words ``w``."""
    return F.struct(F.when(normal != "", F.xxhash64(normal)).alias("h"), F.when(normal != "", F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1).otherwise(0).alias("w"))


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50,
    min_line_docs: int = 20, line_percent: int = 1, min_left_percent: int = 30, cleaned: bool = False, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document with its counts, ``base_failed``, the words left without frequent lines, and ``kept``.

    A line is frequent on a host if it stands in ``min_line_docs`` distinct documents or more that make up at least
    ``line_percent`` of the host's documents. With ``cleaned`` the column ``cleaned`` has the text without its frequent lines; columns named in ``keep`` are returned too.
    A document is depleted if fewer than ``min_left_percent`` of its words are left.
    """
    cols = [f"`{c}`" for c in dict.fromkeys((id_col, text_col, host_col))]
    d = docs.select(*quote_columns(docs, *{id_col: 0, text_col: 0, host_col: 0, **dict.fromkeys(keep, 0)})).withColumns({"_key": row_key(*cols), "_key2": F.hash(*cols)})
    split = d.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{host_col}`").alias("_host"), "_key", "_key2", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    split = split.select("*", spark_words(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n"), has_word).alias("_lines"))
    hashed = F.transform(normal_lines(F.col("_text")), hashed_line)
    rows = split.select(
        "_id", "_host", "_key", "_key2", F.monotonically_increasing_id().alias("_row"), F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeated_window_words(F.col("_words")).alias("n_repeat_words"), hashed.alias("_hashed"))
    rows = materialize(rows, "quality")

    each = rows.select("_row", "_host", "_key", F.posexplode("_hashed").alias("_at", "_l")).select("_row", "_host", "_key", "_at", F.col("_l.h").alias("_line"), F.col("_l.w").alias("_w")).where(F.col("_line").isNotNull())
    seen = each.groupBy("_host", "_line", "_key").agg(F.lit(1).alias("_one")).groupBy("_host", "_line").agg(F.sum("_one").alias("_docs"))
    hosts = rows.groupBy("_host", "_key").agg(F.lit(1).alias("_one")).groupBy("_host").agg(F.sum("_one").alias("_all"))
    frequent = seen.where(F.col("_docs") >= min_line_docs).join(hosts.withColumnRenamed("_host", "_h2"), F.col("_host").eqNullSafe(F.col("_h2"))).where(F.col("_docs") * 100 >= F.col("_all") * line_percent)
    frequent = materialize(frequent.select(F.col("_host").alias("_fhost"), F.col("_line").alias("_fline")), "frequent")

    gone = each.select("_row", "_host", "_at", "_line", "_w").join(frequent, (F.col("_line") == F.col("_fline")) & F.col("_host").eqNullSafe(F.col("_fhost")), "left_semi")
    gone = gone.groupBy("_row").agg(F.sum("_w").alias("_gone"), *([F.collect_list("_at").alias("_frequent")] if cleaned else []))

    left = F.col("n_words") - F.coalesce("_gone", F.lit(0).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "kept")
    out = rows.drop("_hashed", "_host").join(gone, "_row", "left").withColumns({"base_failed": failed, "n_words_left": left})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") * 100 >= F.col("n_words") * min_left_percent))
    if not cleaned and not keep:
        return out.select(F.col("_id").alias(id_col), *counts)
    # equal rows have equal verdicts, which meet the texts by two digests of the row: the texts are shuffled once and written nowhere
    out = out.dropDuplicates(["_key", "_key2"]).select("_key", "_key2", *(["_frequent"] if cleaned else []), F.struct(*counts).alias("_c"))
    rest = F.filter(F.split("_t", "\n"), lambda _, i: ~F.array_contains("_frequent", i))
    text = [F.when(F.col("_frequent").isNull(), F.col("_t")).otherwise(F.array_join(rest, "\n")).alias("cleaned")] if cleaned else []
    d = d.select(*[F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep], F.col(f"`{id_col}`").alias("_id"), *([F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t")] if cleaned else []), "_key", "_key2")
    return d.join(out, ["_key", "_key2"]).select(*[F.col(f"`_keep_{c}`").alias(c) for c in keep], *text, F.col("_id").alias(id_col), *[F.col(f"_c.{c}").alias(c) for c in counts])
