"""Operators on vectors, the statements of this subpackage, and the pipeline."""

import math
import random

import brute
import numpy as np
import oracle
import pytest
from paths import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from trawlkit.llm import components, queries, topk, vector_neighbours

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [(1000, None, 1), (1001, [], 1), (1002, [0.0, 0.0], 1), (1003, [1.0, None], 1), (1004, [math.nan, 1.0], 1), (1005, [math.inf, 1.0], 1), (None, [1.0, 0.0], 1), (1007, [1.0, 0.0, 0.0], 1)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_statement(spark, name):
    assert oracle.compare(spark, oracle.connect(DATA), DATA, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_top_k_against_all_scores(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [float(rng.choice([rng.gauss(0, 1), 0.5, -0.5])) for _ in range(6)], 0) for i in range(700)]
    rows += [(20, rows[20][1], 0), (900, rows[3][1], 0)]
    table = spark.createDataFrame(rows + ODD, VECTORS)
    monkeypatch.setattr(topk, "TASK_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "BATCH_QUERIES", 3)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 2)
    monkeypatch.setattr(topk, "FIRST_READ", 8)
    got = sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 100 == 0).where("query_id < 1000").collect())
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows}
    want = []
    for q in (i for i in whole if i % 100 == 0):
        order = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(order, 1)]
    assert got == sorted(want)


def test_top_k_of_few_and_huge(spark):
    few = spark.createDataFrame([(100, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, [1e30, -1e30], 0)], VECTORS)
    got = topk.top_k(few, F.col("vec_id") == 100).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 2), (2, 1)] and got[1].score == 1024 * 2048
    assert topk.top_k(few.limit(0), F.lit(True)).count() == 0 and topk.top_k(few, F.lit(False)).count() == 0


def test_near_vectors_with_copies_and_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    rows, vec_id = [], 0
    for k, b in enumerate(base):
        for scale in (0.01, 0.05, 0.08):
            for _ in range(25):
                rows.append((vec_id, (b * (1 + vec_id % 3) + rng.normal(size=16) * scale).astype(np.float32).tolist(), k % 2))
                vec_id += 1
    rows += [(5000 + i, rows[i][1], rows[i][2]) for i in range(30)] + [(6000, rows[0][1], None), (6001, [float(x) * 2 for x in rows[1][1]], rows[1][2])]
    monkeypatch.setattr(vector_neighbours, "CHUNK", 8)
    monkeypatch.setattr(vector_neighbours, "TASK_ROWS", 300)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_neighbours.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    same = np.array([[a[2] is not None and a[2] == b[2] for b in rows] for a in rows])
    near = (unit @ unit.T >= 0.93) & same & ~np.eye(len(rows), dtype=bool)
    ids = np.array([r[0] for r in rows])
    for i, vec in enumerate(ids):
        assert got[vec][0] == near[i].sum()
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.array([min(root[i], *root[near[i]]) if near[i].any() else root[i] for i in range(len(rows))])
        if (new == root).all():
            break
        root = new
    assert all(got[v][1] == ids[root[i]] and got[v][2] == (v == ids[root[i]]) for i, v in enumerate(ids))


def test_near_vectors_of_odd_rows(spark):
    table = spark.createDataFrame([*ODD, (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1e30, 0.0], 1)], VECTORS)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vector_neighbours.near_vectors(table).collect()), key=str)
    assert len(got) == len(ODD) + 3
    assert [g for g in got if g[0] in (1, 2)] == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert all(g[1] == 0 and g[2] == g[0] for g in got if g[0] not in (1, 2))
    assert vector_neighbours.near_vectors(table.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1200)] + [(7000, 7000), (7001, 7002), (7002, 7001), (7003, None)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 1 for i in range(1, 61)} | {i: 1000 for i in range(1000, 1200)} | {7001: 7001, 7002: 7001}
    assert got == want


def test_pipeline_against_plain_versions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    one = steps["language_id"](spark, docs, data)
    assert set(rows(one)) <= set(rows(docs)) and one.count() > 0.98 * docs.count()
    two = steps["line_dedup"](spark, docs, data)
    want = {i: t for i, t, _, _ in brute.without_lines([(r.doc_id, r.text, r.source) for r in docs.collect()])}
    assert {r.doc_id: r.text for r in two.collect()} == want and all(r.n_chars == len(r.text) for r in two.collect())
    three = steps["ngram_join"](spark, docs, data)
    assert sorted(r.doc_id for r in three.collect()) == sorted(i for i, _, c in brute.similar([(r.doc_id, r.text) for r in docs.collect()]) if i == c)
    four = steps["personal_data"](spark, docs, data)
    assert four.columns == docs.columns and all(not brute.base_spans(r.text) for r in four.collect())
    assert steps["packing"](spark, four, data).count() >= four.count()


def test_stages_take_odd_rows(spark, data):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (2, "x y", "en", "s", 3), (2, "x y", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, data)
        assert name == "packing" or out.columns == odd.columns
        out.collect()
        stage(spark, odd.limit(0), data).collect()
    assert corpus_pipeline.STAGES[2][1](spark, odd, data).count() == 4


def test_pipeline_runs_whole(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 100
