"""Quality classifier with supervised subword embeddings.

Each word, its character n-grams and each word n-gram (two neighbouring words) have a learned vector in a hashed table; a document is the average of its vectors; a softmax
layer gives the classes. Vectors and layer are trained together by plain stochastic gradient descent in numpy; since a vector's gradient has its small share of the
document as a factor, the vectors have a higher rate than the layer. The layer is linear, so a trained feature comes down to one number, and scoring a text is a
mean of numbers looked up by word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, quote_columns

#: Labelled rows to learn from, at most, and bytes of their features: those with the least hashes of their identifiers. These are the only bounds on what is read.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 2500, 256 << 20
BUCKETS, DIMENSIONS, EPOCHS, RATE, VECTOR_RATE, GRAMS = 1 << 17, 8, 6, 0.5, 10.0, (3, 4)
MEMO_ENTRIES, MEMO_LONGEST = 300_000, 40


def held_out(doc_id: Column) -> Column:
    """True for rows that are never learnt from: crc32 of the identifier as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def word_features(word: str) -> list[int]:
    """Buckets of a word and of all its n-grams with end marks."""
    marked = f"<{word}>".encode()
    out = [zlib.crc32(b"w" + marked) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(marked[i : i + n]) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def pair_features(words: list[str]) -> list[int]:
    """Buckets of word n-grams of two; a word that follows itself has one bucket for all words."""
    same = zlib.crc32(b"p=") % BUCKETS
    return [same if a == b else zlib.crc32(f"p{a} {b}".encode()) % BUCKETS for a, b in zip(words, words[1:], strict=False)]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares, which add up to 1."""
    words = (text or "").split()
    counts: Counter[int] = Counter()
    for w, k in Counter(words).items():
        for f in word_features(w):
            counts[f] += k
    counts.update(pair_features(words))
    keys, values = np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
    return keys, (values / values.sum()).astype(np.float32) if len(values) else values.astype(np.float32)


class SubwordClassifier:
    """Hashed embeddings under a softmax of two classes."""

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> SubwordClassifier:
        rng = np.random.default_rng(seed)
        e = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        w, b = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
        used = [i for i, (k, _) in enumerate(docs) if len(k)]
        share = np.bincount(labels.astype(int), minlength=2) / max(1, len(labels))
        weight = np.where(share > 0, 0.5 / np.maximum(share, 0.02), 1.0)  # both classes count alike
        total, step = EPOCHS * max(1, len(used)), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(used):
                left = 1 - step / total
                step += 1
                keys, shares = docs[i]
                rows = e[keys]
                h = shares @ rows
                z = w @ h + b
                z = np.exp(z - z.max())
                g = z / z.sum()
                g[int(labels[i])] -= 1
                g *= weight[int(labels[i])]
                back = g @ w
                w -= RATE * left * np.outer(g, h).astype(np.float32)
                b -= RATE * left * g
                e[keys] -= VECTOR_RATE * left * shares[:, None] * back
        self.value = (e @ (w[1] - w[0])).astype(np.float64)
        self.bias = float(b[1] - b[0] + np.log(weight[0] / weight[1]))
        return self

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(margin + self.bias, -40, 40))))


class Scorer:
    """Scores texts with a memo of words, bounded in entries and in their length."""

    def __init__(self, model: SubwordClassifier):
        self.model, self.value, self.memo = model, model.value.tolist(), {}

    def _word(self, w: str) -> tuple[float, int]:
        f = word_features(w)
        got = sum([self.value[i] for i in f]), len(f)
        if len(w) <= MEMO_LONGEST and len(self.memo) < MEMO_ENTRIES:
            self.memo[w] = got
        return got

    def score(self, text: str | None) -> float:
        words, memo, value = (text or "").split(), self.memo, self.value
        total, n = 0.0, 0
        for w in words:
            s, k = memo.get(w) or self._word(w)
            total += s
            n += k
        pairs = pair_features(words)
        total += sum([value[i] for i in pairs])
        return self.model.probability(total / (n + len(pairs)) if n else 0.0)


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES
) -> SubwordClassifier:
    """Learn from at most ``max_rows`` labelled rows that are not held out, chosen by the hash of their identifiers, as far as their features have ``max_bytes``.

    What comes to the driver is bounded by both. Rows without label, identifier or text are not learnt from; of
    an identifier that repeats in a table one row serves, the one with the least label or text, chosen before anything is collected.
    """
    lab = labels.select(labels[f"`{id_col}`"].alias("_lid"), labels[f"`{label_col}`"].cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_lid").isNotNull() & ~held_out(F.col("_lid")))
    lab = lab.groupBy("_lid").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_lid"), "_lid").limit(max_rows)
    text = docs.select(*quote_columns(docs, id_col, text_col)).where(F.col(f"`{text_col}`").isNotNull())
    rows = text.join(F.broadcast(lab), F.col(f"`{id_col}`") == F.col("_lid")).select("_lid", "_y", F.col(f"`{text_col}`").alias("_text"))  # lab has max_rows rows of two numbers
    rows = rows.groupBy("_lid", "_y").agg(F.min("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [document_features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k.tobytes() for k, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["id", "y", "keys", "shares"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = materialize(map_batches(rows, run, f"id {kind}, y int, keys binary, shares binary"), "features")
    total, chosen = 0, []
    for r in made.select("id", (F.length("keys") + F.length("shares")).alias("size")).orderBy(F.xxhash64("id"), "id").collect():  # max_rows pairs of numbers
        total += r.size
        if total > max_bytes:
            break
        chosen.append(r.id)
    got = made.where(F.col("id").isin(chosen)).toArrow().to_pydict() if len(chosen) < max_rows else made.toArrow().to_pydict()
    rows = sorted(zip(got["id"], got["y"], got["keys"], got["shares"], strict=True))
    return SubwordClassifier().fit([(np.frombuffer(k, np.int32), np.frombuffer(v, np.float32)) for _, _, k, v in rows], np.array([y for _, y, _, _ in rows]))


def score_quality(docs: DataFrame, model: SubwordClassifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every whole text.

    One pass without shuffle; the model has a fixed size. Null and empty texts get the score of the bias alone; repeated rows each get a row;
    a null identifier is not held out; further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            s = [scorer.score(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(*quote_columns(docs, id_col, text_col)).select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), text_col)
    return map_batches(d, run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
