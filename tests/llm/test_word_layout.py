"""The layout of the distinct-word table with fewer partitions than chunks and buckets, names that clash, and tokenizers that can't be used."""

import hashlib
import json

import pytest

pytest.importorskip("textloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from textloom.llm import distinct_words, tokenizing  # noqa: E402
from textloom.llm.queries import tokenizer_path  # noqa: E402


def want(path, texts):
    tok, out = tokenizing.load_tokenizer(path), []
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 1000])
def test_fewer_partitions_than_chunks_and_buckets(spark, partitions):
    path = tokenizer_path("word_bpe_49k.json")
    texts = [(k, " ".join(f"word{(k * j) % 997} and été" for j in range(40))) for k in range(200)] + [(k, "the same row") for k in [500] * 150] + [(600, None), (601, "")]
    df = spark.createDataFrame([(*r, k, "w") for k, r in enumerate(texts)], "doc_id long, text string, _chunk int, _words string").drop("_x").repartition(3)
    got = distinct_words.encode_decode(df, path, chunk_bytes=4_000, bucket_words=100, keep=("_chunk", "_words"), partitions=partitions)
    assert got.rdd.getNumPartitions() <= 1000
    assert sorted(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want(path, texts)
    assert {(r["_chunk"], r["_words"]) for r in got.collect()} == {(k, "w") for k in range(len(texts))}


def test_dealt(spark):
    df = spark.range(500).select((F.col("id") % 40).cast("int").alias("k"))
    each = distinct_words.dealt(df, "k", 40, 64)
    assert each.select(F.spark_partition_id().alias("p"), "k").where("p <> k").count() == 0
    few = distinct_words.dealt(df, "k", 40, 4)
    assert few.rdd.getNumPartitions() == 4 and few.select("k", F.spark_partition_id().alias("p")).distinct().count() == 40


def test_decoder_is_refused(spark, tmp_path):
    conf = json.loads(open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    conf["decoder"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    path = str(tmp_path / "t.json")
    (tmp_path / "t.json").write_text(json.dumps(conf))
    with pytest.raises(ValueError, match="decoder"):
        distinct_words.encode_decode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path)
