"""Euler tours and what is built on them, on random trees, against SQL over all pairs of ancestors."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordloom.operators import trees
from wordloom.plans import analysis


def forest(seed, texts=40):
    """(doc, i, head): texts of one to fourteen tokens, with several roots, chains and flat trees."""
    r, rows = random.Random(seed), []
    for doc in range(texts):
        n = r.randint(1, 14)
        order = r.sample(range(n), n)
        for k, i in enumerate(order):
            head = None if k == 0 or r.random() < 0.1 else order[k - 1] if r.random() < 0.4 else r.choice(order[:k])
            rows.append((doc, i, head))
    return rows


def tables(spark, rows):
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc", "i", "head"]).astype({"head": "Int64"})
    con.register("frame", frame)
    con.sql("CREATE TABLE tre AS SELECT doc::BIGINT AS doc, i::INTEGER AS i, head::INTEGER AS head FROM frame")
    df = spark.createDataFrame(rows, "doc long, i int, head int").repartition(3)
    return con, df.withColumn("upos", F.when(F.col("i") % 3 == 0, "NOUN").otherwise("VERB")).withColumn("dep", F.when(F.col("i") % 5 == 0, "acl").otherwise("obj"))


@pytest.mark.parametrize("branch,drop", [(1, 3), (2, 1), (1, 0), (5, 10)])
def test_clauses_and_chunks_equal_sql(spark, branch, drop):
    con, df = tables(spark, forest(branch * 10 + drop, 60))
    tour = trees.euler(df).checkpoint()
    clauses = trees.clause_groups(df, branch, drop, tour=tour).checkpoint()
    want = con.sql(f"WITH RECURSIVE {analysis.clause_sql(branch, drop)} SELECT doc, i, clause FROM cls").fetchall()
    assert sorted(tuple(r) for r in clauses.collect()) == sorted(want)
    chunks = {(r.doc, r.chunk_head, r.depth, tuple(r.members), tuple(r.extras)) for r in trees.chunk_model(df, 3, clauses, tour=tour).filter("not singleton").collect()}
    sql = f"WITH RECURSIVE {analysis.clause_sql(branch, drop)}, {analysis.chunk_sql(3)} SELECT doc, head, depth, list_sort(list(i) FILTER (WHERE kind <> 'extra')), list_sort(coalesce(list(i) FILTER (WHERE kind = 'extra'), [])) FROM mem GROUP BY 1, 2, 3"
    assert chunks == {(a, b, c, tuple(d), tuple(e)) for a, b, c, d, e in con.sql(sql).fetchall()}


@pytest.mark.parametrize("roll", [False, True])
def test_highlights_equal_sql(spark, roll):
    con, df = tables(spark, forest(77, 80))
    branches, sets = trees.highlights(df, roll)
    got = {(r.doc, r.branch, ",".join(map(str, r.members)), r.rolled) for r in sets.collect()}
    assert got == {tuple(r) for r in con.sql(f"WITH RECURSIVE {analysis.highlight_sql(roll)}").fetchall()}
    parts = {(r.doc, r.i): r.branch for r in branches.collect()}
    assert all(str(i) in next(m for d, b, m, _ in got if (d, b) == (doc, branch)).split(",") for (doc, i), branch in parts.items())
    # A set hangs together by the tree's edges, without a search: one edge less than tokens inside it.
    heads = {(r.doc, r.i): r["head"] for r in df.collect()}
    for doc, _, members, _ in got:
        inside = set(map(int, members.split(",")))
        assert sum(heads[doc, i] in inside for i in inside) == len(inside) - 1


def test_tours_of_odd_trees(spark):
    rows = [("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 3), ("a", 4, 9), ("a", 5, 3), ("b", 7, None)] + [("deep", i, i + 1) for i in range(300)] + [("deep", 300, None)]
    df = spark.createDataFrame(rows, "doc string, i int, head int").withColumn("upos", F.lit(None).cast("string")).withColumn("dep", F.col("upos"))
    got = {(r.doc, r.i): (r.depth, r.entry, r.size, r.height, r.root) for r in trees.euler(df).filter("doc <> 'deep' or i % 100 = 0").collect()}
    assert got == {
        ("a", 3): (0, 0, 2, 1, 3), ("a", 5): (1, 1, 1, 0, 3), ("a", 4): (0, 2, 1, 0, 4), ("b", 7): (0, 0, 1, 0, 7),
        ("deep", 0): (300, 300, 1, 0, 300), ("deep", 100): (200, 200, 101, 100, 300), ("deep", 200): (100, 100, 201, 200, 300), ("deep", 300): (0, 0, 301, 300, 300),
    }
    few = df.filter("doc <> 'deep'")
    assert {(r.doc, r.chunk_head, tuple(r.members), r.pos) for r in trees.chunk_model(few).collect()} == {("a", 3, (3,), "ROOT"), ("a", 5, (5,), "DEFAULT")}
    assert {(r.doc, r.i): (r.chunk_head, r.depth) for r in trees.canonical_chunks(few).collect()} == {("a", 3): (3, 0), ("a", 5): (5, 0), ("a", 4): (4, -1), ("b", 7): (7, -1)}
    none = df.limit(0)
    assert trees.euler(none).count() == trees.clause_groups(none).count() == trees.chunk_model(none).count() == trees.highlights(none)[1].count() == 0
