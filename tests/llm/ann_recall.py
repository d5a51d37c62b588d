"""Recall of one shard's graph against brute force: ``python -m tests.llm.ann_recall [rows ...]``.

The sets are hard in different ways: clusters far apart, clusters that touch, no structure at all.
"""
import sys
import time

import numpy as np

from lethe.llm import ann


def clustered(n: int, clusters: int, sigma: float, dims: int = 64, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    return centres[r.integers(0, clusters, n)] + sigma * r.normal(size=(n, dims))


def recall(x: np.ndarray, queries: int = 400, k: int = 10) -> tuple[float, int, float]:
    """(share of the true neighbours found, points not reached, seconds of building)."""
    began = time.time()
    graph, starts = ann.build_graph(x)
    took = time.time() - began
    near = np.ascontiguousarray(x, ann.precision(x))
    asked = np.random.default_rng(3).permutation(len(x))[:queries]
    hit = 0
    step = max(1, min(64, ann.CELLS // len(x)))
    for at in range(0, len(asked), step):
        some = asked[at:at + step]
        found, _ = ann.beam_search(near, graph, near[some], starts, ann.QUERY_BEAM)
        for i, f in zip(some, found):
            f = f[(f >= 0) & (f != i)]
            d = ((x[f] - x[i]) ** 2).sum(axis=1)
            true = ((x - x[i]) ** 2).sum(axis=1)
            true[i] = np.inf
            want = np.argpartition(true, k)[:k]
            hit += len(set(f[np.argsort(d, kind="stable")[:k]]) & set(want))
    return hit / (k * len(asked)), len(ann.unreached(graph, starts)), took


if __name__ == "__main__":
    for n in map(int, sys.argv[1:] or ["4000", "8000", "20000"]):
        for name, x in (("50 clusters, 0.3", clustered(n, 50, 0.3)), ("50 clusters, 0.6", clustered(n, 50, 0.6)),
                        ("2000 clusters, 0.3", clustered(n, 2000, 0.3)), ("normal", clustered(n, 1, 1.0))):
            print(n, name, "recall %.3f, not reached %d, built in %.0f s" % recall(x), flush=True)
