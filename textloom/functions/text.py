"""Coercion and normalisation of one text column, as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import ENGLISH

#: White space at both ends as Unicode sees it, with the separators that a plain trim leaves.
EDGE_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
#: A token: two word characters or more.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def coerce_text(c: Column) -> Column:
    """Null as empty text, anything else as its text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def preprocess(c: Column) -> Column:
    """Lower case, without white space at either end."""
    return F.regexp_replace(F.lower(c), f"^{EDGE_SPACE}+|{EDGE_SPACE}+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def without_stop_words(words: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """``words`` less the stop words, order and repeats kept; the list is a literal, looked up by hash."""
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def is_blank(c: Column) -> Column:
    return F.length(preprocess(coerce_text(c))) == 0


def sanitise_term(c: Column) -> Column:
    return F.translate(c, " ", "_")
