"""Counts of terms without a shuffle, and weights over a vocabulary without a limit by packets."""

import pytest

from textloom.operators.vectorize import Matrix, term_frequency, token_table

TEXTS = ["red green red blue", "", None, "blue blue lime red", "the of", "lime green red lime lime"] * 4


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_where_the_row_is(spark, docs):
    tf = term_frequency(token_table(docs.coalesce(1), "text", "doc_id"))
    assert plan(tf).count("Exchange") == plan(docs).count("Exchange") and "Aggregate" not in plan(tf)
    want = {(i, w, (t or "").split().count(w)) for i, t in enumerate(TEXTS) for w in set((t or "").split()) - {"the", "of"}}
    assert {tuple(r) for r in tf.collect()} == want


@pytest.mark.parametrize("rows", [1, 5, 10_000])
def test_packets_give_the_weights_of_a_limit_beyond_all_terms(spark, docs, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        some, every = Matrix.of(docs, "text", "doc_id", 100), Matrix.of(docs, "text", "doc_id", None)
        assert "hashpartitioning(row_id" not in plan(every.long)
        key = lambda m: sorted((r.row_id, r.term, r.term_idx, r.tf, round(r.weight, 12), round(r.unit, 12)) for r in m.long.collect())
        assert key(some) == key(every) and len(key(every)) == 4 * (3 + 3 + 3)
        v = {r.row_id: (r.t, r.w) for r in every.vectors.collect()}
        assert len(v) == len(TEXTS) and all((v[i] == ([], [])) == (i % 6 in (1, 2, 4)) for i in v) and all(abs(sum(x * x for x in w) - 1) < 1e-12 for t, w in v.values() if t)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_are_counted_some_rows_at_a_time():
    """Parts have whole rows, in order, and a bounded number of words unless one row alone has more."""
    import pyarrow as pa

    from textloom.operators.vectorize import _parts

    lists = [["a"] * n if n is not None else None for n in (3, 0, None, 4, 9, 1, 1, 5, 0)]
    b = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(lists, pa.list_(pa.string()))], ["row_id", "words"])
    parts = [p.to_pylist() for p in _parts(b, 5)]
    assert [r for p in parts for r in p] == b.to_pylist()
    assert all(len(p) == 1 or sum(len(r["words"] or ()) for r in p) <= 5 for p in parts) and len(parts) == 5
    assert not list(_parts(b.slice(0, 0), 5))
