import random

import pytest

from stratafold.operators import components
from stratafold.operators.components import connected_components, contract


@pytest.fixture(autouse=True, params=[components.FEW, 0])
def few(request, monkeypatch):
    """Both ways: ended by one task, and by rounds only."""
    monkeypatch.setattr(components, "FEW", request.param)
    monkeypatch.setattr(components, "CHUNK", 200_000 if request.param else 7)


def by_hand(edges):
    label = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            label.setdefault(a, {a})
            label.setdefault(b, {b})
            if label[a] is not label[b]:
                whole = label[a] | label[b]
                for x in whole:
                    label[x] = whole
    return {x: min(s) for x, s in label.items()}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([20, 60, 300])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.4, 0.8])))]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == by_hand(edges)


def test_chain_star_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (5, None), (1, 2), (2, 1)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == by_hand(edges)


def test_strings_and_empty(spark):
    rows = connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()
    assert {(r["node"], r["component"]) for r in rows} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contract_keeps_components():
    edges = [(5, 3), (3, 1), (9, 8), (8, 9)]
    assert by_hand(contract(edges)) == by_hand(edges)
