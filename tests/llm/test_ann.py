import numpy as np
import pytest

from lethe.llm import ann
from tests.llm.conftest import rows_of


def nearest(rows, q, vector):
    d = sorted((float(np.sqrt(((np.array(v) - np.array(vector)) ** 2).sum())), i) for i, v in rows if i != q)
    return d[:10]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, Embedding_ string, shard int")


def test_recall_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_LEAST", 500)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(0, 20, 1800)] + rng.normal(size=(1800, 24)) * 0.6).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.op10_ann(frame(spark, rows)).collect()
    found = 0
    for q in range(0, 1800, 100):
        want = nearest(rows, q, rows[q][1])
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [s for _, _, s in mine] == sorted(s for _, _, s in mine)
        found += len({i for _, i in want} & {i for _, i, _ in mine})
        for _, i, s in mine:
            assert s == pytest.approx(float(np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum())), rel=1e-14)
    assert found / 180 >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [1.0, 0.5]), (200, [0.0, 0.0]), (300, None), (400, [nan, 1.0]), (500, [inf, 1.0]),
            (600, [None, 1.0]), (None, [1.0, 0.1]), (700, [3.0, 4.0]), (700, [3.0, 4.0]), (800, [1.0, 2.0, 3.0]), (801, [1.0, -0.0])]
    got = rows_of(ann.op10_ann(frame(spark, rows)), "query_id", "rank", "vec_id", "score")
    assert {r[0] for r in got} == {0, 100, 700}  # 800 has no other vector of its length
    assert [r[2] for r in got if r[0] == 0] == list(range(1, 11)) and all(r[3] == 0.0 for r in got if r[0] == 0)
    assert [r[2] for r in got if r[0] == 100] == list(range(10)) and {r[3] for r in got if r[0] == 100} == {0.5}
    assert [r[2] for r in got if r[0] == 700] == [100, *range(9)]


def test_few_and_none(spark):
    assert rows_of(ann.op10_ann(frame(spark, []))) == []
    assert rows_of(ann.op10_ann(frame(spark, [(0, [1.0]), (1, [2.0])])), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 1.0)]


def test_pruning_keeps_diverse_neighbours():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]], np.float32)
    kept = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 1, 0, -1]]), 1.2)[0]
    assert kept[kept >= 0].tolist() == [1, 3]


@pytest.mark.parametrize("large", [0, 500])
def test_a_very_large_vector(spark, large):
    """As a query, and as the smallest id of its shard: nothing is lost."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[large] *= np.float32(1e30)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.op10_ann(frame(spark, rows)).collect()
    found = 0
    for q in range(0, 600, 100):
        mine = [r["vec_id"] for r in got if r["query_id"] == q]
        assert len(mine) == 10
        if q != large:
            found += len(set(mine) & {i for _, i in nearest(rows, q, rows[q][1])})
    assert found / 50 >= 0.9


@pytest.mark.parametrize("clusters, sigma", [(50, 0.3), (50, 0.6), (400, 0.3)])
def test_graph_holds_together_between_clusters(clusters, sigma):
    from tests.llm.ann_recall import clustered, recall
    found, lost, _ = recall(clustered(3000, clusters, sigma), 150)
    assert found >= 0.95 and lost == 0


def test_links_reach_every_point_of_tight_far_groups():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 4)) * 1e-3 + 100 * c for c in range(40)])
    graph, starts = ann.build_graph(x)
    assert len(ann.unreached(graph, starts)) == 0 and graph.shape[1] == ann.DEGREE + ann.LINKS


def test_rows_that_share_an_id_and_clashing_columns(spark):
    rows = [(100, [1.0, 0.0], 5, [0.0]), (100, [1.0, 0.25], 6, [0.0]), (7, [1.0, 0.5], 7, [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, VEC_ID long, Embedding array<double>")
    got = rows_of(ann.op10_ann(df), "query_id", "rank", "vec_id", "score")
    assert got == sorted([(100, 1, 100, 0.25), (100, 2, 7, 0.5), (100, 1, 7, 0.25), (100, 2, 100, 0.25)])
