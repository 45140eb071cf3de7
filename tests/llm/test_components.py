"""Components and stars against union by a dictionary."""

import numpy as np
import pytest

from kvspark.llm._components import components
from kvspark.llm.ngram_join import stars

rng = np.random.default_rng(2)
order = rng.permutation(1000).tolist()
CASES = {
    "none": [],
    "loop": [(1, 1)],
    "path": [(i, i + 1) for i in range(300)],
    "shuffled path": list(zip(order[:-1], order[1:], strict=True)),
    "repeated and turned": [(1, 2), (2, 1), (1, 2), (2, 3)],
    "random": rng.integers(0, 3000, (2500, 2)).tolist(),
    "large ids in the middle": [(5000, i) for i in range(600)] + [(5001, i) for i in range(590, 900)],
}


def expected(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in list(up) if root(x) != x)


@pytest.mark.parametrize("name", CASES)
def test_stars(name):
    pairs = np.array(CASES[name], dtype=np.int64).reshape(-1, 2)
    assert sorted((b, a) for a, b in stars(pairs[:, 0], pairs[:, 1]).tolist()) == expected(CASES[name])


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in CASES[name]], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == expected(CASES[name])


def test_a_null_end_is_left_out(spark):
    edges = spark.createDataFrame([(1, None), (None, 2), (4, 3)], "a long, b long")
    assert [tuple(r) for r in components(edges).collect()] == [(4, 3)]
