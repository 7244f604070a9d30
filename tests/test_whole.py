"""Registered queries cover whole tables and whole values; the wanted rows come from the files, not from a twin."""

import pyarrow.parquet as pq

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def _columns(table, *names):
    t = pq.read_table(f"{DIR}/{table}.parquet", columns=list(names))
    return [t.column(n).to_pylist() for n in names]


def _rows(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, DIR).collect())


def test_unnest_covers_whole_vectors(spark):
    vectors = list(zip(*_columns("embeddings", "vec_id", "embedding")))
    assert _rows(spark, "sql_unnest", "vec_id", "x") == sorted((i, x) for i, v in vectors for x in v)
    assert _rows(spark, "sql_posexplode", "vec_id", "i", "x") == sorted((i, k, x) for i, v in vectors for k, x in enumerate(v, 1))


def test_full_join_reads_both_tables_whole(spark):
    supplier, customer = ({k: b for k, b in zip(*_columns(t, *c))} for t, c in (("supplier", ("s_suppkey", "s_acctbal")), ("customer", ("c_custkey", "c_acctbal"))))
    rows = {(r["s_suppkey"], r["c_custkey"]) for r in entry.queries()["sql_full_join"](spark, DIR).collect()}
    both = {k for k in supplier.keys() & customer.keys() if supplier[k] < customer[k]}
    assert both and supplier.keys() - both and customer.keys() - both
    assert rows == {(k, k) for k in both} | {(k, None) for k in supplier.keys() - both} | {(None, k) for k in customer.keys() - both}


def test_except_subtracts_a_whole_table(spark):
    (docs,), (labelled,) = _columns("documents", "doc_id"), _columns("labels", "doc_id")
    assert set(docs) - set(labelled)
    assert _rows(spark, "sql_except", "k") == sorted((k,) for k in set(docs) - set(labelled))
