"""The planted panel: each operator must find the structure that was put in."""

import numpy as np
import pytest

from weftline.functions import kernels
from weftline.operators import graph, pairstats, panel
from weftline.sources.graphs import degree
from weftline.sources.panels import synthetic_prices
from weftline.sources.universe import universe


@pytest.fixture(scope="module")
def prices(spark):
    return synthetic_prices(spark).persist()


@pytest.fixture(scope="module")
def wide(prices):
    return prices.toPandas().pivot(index="date", columns="ticker", values="price")


@pytest.fixture(scope="module")
def made(spark, prices):
    node, edges = graph.statistical_graph(prices, panel.log_returns(prices), universe(spark), surrogates=60)
    return node.persist(), edges.persist()


def test_planted_cointegration(prices):
    found = {frozenset((r["a"], r["b"])) for r in pairstats.cointegrated_pairs(prices).collect()}
    assert frozenset(("C_COINT", "D_COINT")) in found


def test_transfer_entropy_is_directional(prices):
    te = {(r["src"], r["dst"]): r["te"] for r in pairstats.transfer_entropies(panel.log_returns(prices)).collect()}
    assert te["A_LEADER", "B_FOLLOWER"] > te["B_FOLLOWER", "A_LEADER"]


def test_set_based_and_kernel_entropies_agree(prices, wide):
    r = np.log(wide).diff().dropna()
    te = {(x["src"], x["dst"]): x["te"] for x in pairstats.transfer_entropies(panel.log_returns(prices)).collect()}
    for (a, b), v in te.items():
        assert abs(kernels.transfer_entropy(r[a].to_numpy(), r[b].to_numpy()) - v) < 1e-9


def test_kalman(spark, prices):
    pair = spark.createDataFrame([("D_COINT", "C_COINT")], "a string, b string")
    rows = pairstats.kalman_hedges(prices, pair, log=True).orderBy("date").collect()
    assert rows[-1]["beta"] > 0 and np.mean([abs(r["spread"]) for r in rows]) < 1.0


def test_significance(wide):
    r = np.log(wide).diff().dropna()
    a, b, e = (r[c].to_numpy() for c in ("A_LEADER", "B_FOLLOWER", "E_INDEP"))
    assert kernels.te_significance(a, b, surrogates=200, seed=0)[1] <= 0.05
    assert kernels.te_significance(a, e, surrogates=200, seed=0)[1] > 0.05


def test_graph(made):
    node, edges = made
    assert node.count() == 5 and edges.count() > 0
    n = {r["id"]: r["degree"] for r in degree(edges).collect()}
    assert n.get("E_INDEP", 0) <= n["C_COINT"]


def test_centrality_and_hidden_linkages(made):
    node, edges = made
    rows = graph.centrality(edges, node).collect()
    assert len(rows) == 5 and abs(sum(r["pagerank"] for r in rows) - 1) < 1e-6
    assert {"pagerank", "out_strength", "in_strength", "betweenness"} <= set(rows[0].asDict())
    assert graph.hidden_linkages(edges, node).collect() == []  # all sectors are unknown
