"""Token counts, and word-wise encoding that gives the ids of a tokenizer library.

Both rest on cutting a text where the tokenizer cuts it anyway, so that each distinct piece is encoded once for a worker and
looked up after that. A memo is bounded by ``MEMO_ENTRIES`` and ``MEMO_LONGEST``; beyond that, pieces are encoded anew, with the same result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, quote_columns

MEMO_ENTRIES, MEMO_LONGEST, ENCODE_BYTES = 400_000, 40, 1 << 20
#: Words that a worker remembers with their ids, about 200 bytes each, and words that are encoded as one text.
WORD_ENTRIES, JOINED_WORDS = 800_000, 400

#: A single space between two characters that are no white space: a byte-level BPE with the usual pattern always starts a
#: piece there, since no piece has a space after its first character and a run of one space never ends in a look-ahead.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


@cache
def load_tokenizer(path: str):
    """The tokenizer of a worker process, on one thread, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def safe_pieces(text: str) -> list[str]:
    """Pieces whose encodings, one after another, are the encoding of ``text``; each but the first keeps its leading space."""
    first, *rest = SAFE_CUT.split(text)
    return [first, *[" " + x for x in rest]]


def byte_length(piece: str | bytes) -> int:
    return len(piece) if isinstance(piece, bytes) or piece.isascii() else len(piece.encode())


def balanced(pieces: Iterable[str | bytes], most: int = ENCODE_BYTES) -> Iterator[list]:
    """Lists of about ``most`` bytes of UTF-8; a longer piece has a list of its own."""
    batch, held = [], 0
    for p in pieces:
        n = byte_length(p)
        if batch and held + n > most:
            yield batch
            batch, held = [], 0
        batch.append(p)
        held += n
    if batch:
        yield batch


class TokenCounter:
    """Counts tokens of texts; keeps lengths of pieces, never ids."""

    def __init__(self, path: str):
        self.tok, self.memo = load_tokenizer(path), {}

    def count(self, texts: list[str]) -> list[int]:
        split = [safe_pieces(t) if t else [] for t in texts]
        memo, new = self.memo, {}
        for pieces in split:
            new.update(dict.fromkeys(p for p in pieces if p not in memo))
        for batch in balanced(new):
            new.update(zip(batch, map(len, self.tok.encode_batch_fast(batch, add_special_tokens=False)), strict=True))
        if room := MEMO_ENTRIES - len(memo):
            memo.update([(k, v) for k, v in new.items() if len(k) <= MEMO_LONGEST][:room])
        return [sum([memo[p] if p in memo else new[p] for p in pieces]) for pieces in split]


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every whole text.

    Method: batches in Arrow functions that return lengths only; batches are balanced by bytes and long texts are split at
    safe boundaries. No shuffle. The tokenizer must be a byte-level BPE with the usual pattern and no normaliser (checked).

    A null text counts as empty (0 bytes, 0 tokens); repeated rows each get a row; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer_path)
        check_byte_level(tokenizer_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(*quote_columns(docs, id_col, text_col)), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


@cache
def check_byte_level(path: str) -> None:
    """Refuse a tokenizer for which the cuts above are not known to be safe."""
    import json

    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    pre = conf.get("pre_tokenizer") or {}
    if conf.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: only a byte-level BPE without normaliser and prefix space can be counted piece by piece")
    if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in conf.get("added_tokens", [])):
        raise ValueError(f"{path}: an added token has white space")


@cache
def check_word_level(path: str) -> None:
    """Refuse a tokenizer that may join text across white space."""
    import json

    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    kinds = [n["type"] for n in (conf.get("normalizer") or {}).get("normalizers", [])]
    split = next(iter((conf.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
    if kinds != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or not split.get("invert") or "\\s" not in split["pattern"]["Regex"]:
        raise ValueError(f"{path}: only a tokenizer that drops white space can be used word by word")
    if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in conf.get("added_tokens", [])):
        raise ValueError(f"{path}: an added token has white space")


@cache
def check_no_decoder(path: str) -> None:
    """Refuse a tokenizer whose library doesn't decode by joining pieces with spaces."""
    import json

    with open(path, encoding="utf-8") as f:
        if json.load(f).get("decoder"):
            raise ValueError(f"{path}: a tokenizer with a decoder of its own can't be decoded piece by piece")


class WordEncoder:
    """Encodes texts word by word, where words are runs between ASCII white space.

    The tokenizer drops white space and looks at no character beyond it (NFC composes nothing across a space, lower-casing is
    by character), so the ids of a text are those of its words in order.
    """

    #: Parts words that are encoded as one text; a word that has it is encoded alone.
    MARK = "\x01"

    def __init__(self, path: str):
        check_word_level(path)
        self.tok, self.memo = load_tokenizer(path), {}
        self.mark = self.tok.encode(self.MARK, add_special_tokens=False).ids

    def _alone(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found, strict=True)}

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit integers."""
        out, mark = {}, self.MARK.encode()
        for batch in balanced(words):
            odd = [w for w in batch if mark in w] if len(self.mark) == 1 else batch
            out |= self._alone(odd)
            groups = list(batched([w for w in batch if w not in out], JOINED_WORDS))
            texts = [(b" %b " % mark).join(g).decode() + f" {self.MARK}" for g in groups]
            for g, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = (np.flatnonzero(ids == self.mark[0]) * 4).tolist()
                if len(ends) != len(g):
                    out |= self._alone(list(g))
                    continue
                raw, at = ids.tobytes(), 0
                for w, end in zip(g, ends, strict=True):
                    out[w], at = raw[at:end], end + 4
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode().split() for t in texts]
        memo = self.memo
        new = self.encode_words(set().union(*split).difference(memo))
        room = max(0, WORD_ENTRIES - len(memo))
        memo.update(new)
        out = [b"".join(map(memo.__getitem__, words)) for words in split]
        short = 0
        for w in new:
            short += len(w) <= MEMO_LONGEST
            if len(w) > MEMO_LONGEST or short > room:
                del memo[w]
        return out


@cache
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker process; what it remembers serves all tasks of that worker."""
    return WordEncoder(path)
