"""The manifest against a plain build of the whole tree, with few and many rounds, and on odd tables."""

import hashlib
import random

import pytest

pytest.importorskip("textloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from textloom.llm import merkle  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, id int, pos int, digest string, tie string"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes):
    """The root, and for each node the siblings left and right of its way up."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, p in enumerate(at):
            run = range(p // 3 * 3, min(p // 3 * 3 + 3, len(level)))
            ways[k].append(("".join(level[j] for j in run if j < p), "".join(level[j] for j in run if j > p)))
        level = [h(*level[j : j + 3]) for j in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], ways


def brute(rows, changed):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), leaf(*r), leaf(r[0], changed(r[0], r[1]), *r[2:]), r[0]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda x: x[:2])
        built[s] = climb([x[1] for x in trees[s]])
    root, rest = climb([built[s][0] for s in order])
    out = []
    for s, over in zip(order, rest, strict=True):
        sub, ways = built[s]
        for (_, own, now, i), way in zip(trees[s], ways, strict=True):
            node = now
            for a, b in way + over:
                node = h(a, node, b)
            out.append((i, s, own, sub, root, h(*(a + b for a, b in way + over)), node, node == root))
    return out


def change(i, text):
    return text.replace("\n", "") if text is not None and i is not None and i % 2 == 0 else text


key = lambda r: tuple((v is None, v) for v in r)


def both(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 0, 0, 0, "", "") for r in rows], SCHEMA).repartition(3)
    changed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.merkle_manifest(df, found={"text": changed}, **settings).select("doc_id", "source", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, change), key=key)
    return got


def some(n, sources, seed=1):
    rnd = random.Random(seed)
    pick = lambda: rnd.choice((None, "", "-", "a\nb", "ü\n\n€", "1:x", "x" * 5000))
    return [(rnd.choice((None, rnd.randint(-5, n))), pick(), rnd.choice((None, "en")), rnd.choice(sources), rnd.choice((None, 0, 7))) for _ in range(n)]


def test_small(spark):
    got = both(spark, some(60, [None, "", "b", "a", "é", "Z"]))
    assert {r.verified for r in got} == {True, False}
    both(spark, [(5, "only\none", None, None, None)])
    both(spark, [(4, "only\none", None, "s", 1)])
    both(spark, [(k, "t\n", "en", "s", 1) for k in range(4)])
    both(spark, [(1, "same\n", "en", "s", 1)] * 7)


@pytest.mark.parametrize("levels,top_most,sources", [(1, 2, ["a", "b", "c"]), (2, 4, ["a"]), (1, 5, [f"s{k}" for k in range(40)] + [None]), (6, 3, [f"s{k}" for k in range(20)])])
def test_rounds(spark, levels, top_most, sources):
    """Small blocks and a small top: several rounds, and a tree over many sources that the driver doesn't build as a whole."""
    both(spark, some(150, sources, 4), levels=levels, top_most=top_most)


def test_empty_and_fields(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.merkle_manifest(none).columns == ["doc_id", "source", "leaf", "subroot", "root", "proof", "folded_root", "verified"] and merkle.merkle_manifest(none).count() == 0
    df = spark.createDataFrame([("k1", "a", 1), ("k2", "b", 2), ("k3", "b", 3)], "key string, host string, n int")
    got = merkle.merkle_manifest(df, ["key", "n"], "key", "host").collect()
    assert {r.verified for r in got} == {True} and {r.key: r.leaf for r in got}["k2"] == h("2:k21:2")
