import random

import pytest

from spanloom.llm.components import components


def plain(edges):
    head = {x: x for e in edges for x in e}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("shape", ["path", "back", "star", "high star", "random", "shuffled path", "none", "loops"])
def test_components(spark, shape):
    rng = random.Random(3)
    names = list(range(60))
    rng.shuffle(names)
    edges = {
        "path": [(i, i + 1) for i in range(60)], "back": [(i + 1, i) for i in range(60)], "star": [(0, i) for i in range(1, 50)], "high star": [(99, i) for i in range(50)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(70)], "shuffled path": list(zip(names, names[1:], strict=False)), "none": [], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[shape]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == plain(edges) and len(got) == len({r.node for r in got})
