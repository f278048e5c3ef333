"""Hand-computed cases of single operators."""

import datetime as dt
import re
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import kernels
from weftline.functions import text as tx
from weftline.operators import correlation, graph, models, news, pairstats, panel, propagation
from weftline.sources import announcements as ann
from weftline.sources import graphs, panels, signals
from weftline.sources.universe import companies, names, universe

D = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(8)]
NAN = float("nan")


def prices(spark, **series):
    rows = [(d, t, p) for t, s in series.items() for d, p in zip(D, s, strict=False)]
    return spark.createDataFrame(rows, "date date, ticker string, price double")


def test_log_returns_respect_gaps_zeros_and_nan(spark):
    p = prices(spark, X=[100.0, None, 110.0, 121.0], Y=[1.0, 2.0, 0.0, 5.0], Z=[1.0, NAN, NAN, NAN], W=[None] * 4)
    got = {(r["ticker"], r["date"]): r["r"] for r in panel.log_returns(p).collect()}
    assert got == {("X", D[3]): pytest.approx(log(1.1)), ("Y", D[1]): pytest.approx(log(2))}
    assert [r[0] for r in panel.dead_tickers(p, spark.createDataFrame([("W",), ("X",)], "ticker string")).collect()] == ["W"]


def test_forward_returns_truncate_and_find_the_next_price(spark):
    p = prices(spark, X=[10.0, 11.0, 12.0], Y=[None, 5.0, 6.0, 9.0])
    got = {(r["ticker"], r["date"]): r["fwd"] for r in panel.forward_returns(p, 2).collect()}
    assert got["X", D[0]] == pytest.approx(0.2) and got["X", D[1]] == pytest.approx(12 / 11 - 1) and got["X", D[2]] is None
    at = {(r["ticker"], r["date"]): r["fwd"] for r in panel.forward_at(p, 2).collect()}
    assert at["Y", D[0]] == pytest.approx(0.8) and at["X", D[3]] is None
    full = {(r["ticker"], r["date"]): r["fwd"] for r in panel.forward_returns(p, 2, require_full=True).collect()}
    assert full["X", D[1]] is None


def test_trailing_and_market_volatility_differ_in_short_windows(spark):
    dense = panel.dense_returns(prices(spark, X=[1.0, 2.0, 1.0, 2.0], Y=[1.0, 1.0, 1.0, 1.0]))
    vol = {(r["ticker"], r["date"]): r["vol"] for r in panel.trailing_vol(dense).collect()}
    assert vol["X", D[1]] == 0.0 and vol["X", D[2]] == pytest.approx(np.std([log(2), -log(2)], ddof=1))
    market = panel.market(dense).orderBy("date").collect()
    assert [r["mkt_vol"] for r in market] == [0.0] * 3 and market[0]["mkt_return"] == pytest.approx(log(2) / 2)


def test_shocks_and_slices_are_inclusive(spark):
    r = spark.createDataFrame([(D[0], "X", 0.02), (D[1], "X", -0.02), (D[2], "X", 0.019), (D[3], "X", 0.5)], "date date, ticker string, r double")
    assert sorted(x["date"] for x in panel.shocks(r, 0.02, str(D[0]), str(D[1])).collect()) == D[:2]
    assert panel.tail(r, 2).count() == 2


def test_listwise_and_pairwise(spark):
    p = prices(spark, X=[1.0, 2.0, None], Y=[1.0, None, 3.0])
    assert [r[0] for r in panel.listwise(p, "price").select("date").distinct().collect()] == [D[0]]
    assert panel.pairs(p, "price").count() == 1


def test_constant_series_has_no_correlation(spark):
    r = spark.createDataFrame([(d, t, v) for t, s in {"A": [1.0, 2.0, 3.0], "B": [2.0, 4.0, 6.0], "C": [1.0, 1.0, 1.0]}.items() for d, v in zip(D, s, strict=False)], "date date, ticker string, r double")
    got = {(x["a"], x["b"]): x["rho"] for x in correlation.correlations(r).collect()}
    assert got["A", "B"] == pytest.approx(1) and got["A", "C"] is None


def test_discretiser():
    assert kernels.discretise(np.arange(8.0), 4).tolist() == [0, 1, 1, 2, 2, 3, 3, 3]
    assert kernels.discretise(np.zeros(8), 4).tolist() == [0, 1, 1, 2, 2, 3, 3, 3]


def test_short_series_have_no_entropy():
    assert kernels.transfer_entropy(np.ones(2), np.ones(2)) == 0.0
    assert kernels.te_significance(np.arange(19.0), np.arange(19.0)) == (0.0, 1.0)


def test_mackinnon_levels():
    for tau, p in ((-3.897, 0.01), (-3.337, 0.05), (-3.045, 0.10)):
        assert abs(kernels.mackinnon_p(tau) - p) < 0.001
    assert kernels.mackinnon_p(1.0) == 1.0 and kernels.mackinnon_p(-20) == 0.0
    x = np.arange(50.0)
    assert kernels.engle_granger_p(2 * x + 1, x) == 0.0


def test_kalman_first_step():
    out = kernels.kalman_hedge(np.array([2.0]), np.array([3.0]))
    q = 1e-4 / (1 - 1e-4)
    cov, obs = np.ones((2, 2)) + q * np.eye(2), np.array([1.0, 3.0])
    state = cov @ obs * 2 / (obs @ cov @ obs + 1e-3)
    assert out[0, :2] == pytest.approx(state) and out[0, 2] == 2.0


@pytest.mark.parametrize("p, reject", [([0.01, 0.04, 0.03, 0.20], [True, False, False, False]), ([0.01, 0.02, 0.03, 0.04], [True] * 4), ([0.01, NAN, NAN], [True, False, False])])
def test_false_discovery_rate(spark, p, reject):
    rows = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    assert [r["reject"] for r in pairstats.bh_reject(rows).orderBy("k").collect()] == reject


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, kind string, weight double")


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, sector string, grp string")


def test_evidence_folds_and_hidden_linkages(spark):
    e = graph.fold(edges_of(spark, [("u", "v", "same_group", 1.0), ("u", "v", "cointegration", 0.97), ("u", "v", "transfer_entropy", 0.05), ("v", "w", "transfer_entropy", 0.5), ("w", "u", "same_group", 1.0)]))
    got = {(r["src"], r["dst"]): (r["weight"], r["k"]) for r in e.select("src", "dst", "weight", graph.kinds().alias("k")).collect()}
    assert got["u", "v"] == (pytest.approx(2.02), "cointegration,same_group,transfer_entropy")
    node = nodes_of(spark, [("u", "U", "s", ""), ("v", "V", "s", "g"), ("w", "W", "t", "")])
    assert [(r["src"], r["dst"]) for r in graph.hidden_linkages(e, node).collect()] == [("v", "w")]
    s = {r["id"]: (r["out_strength"], r["in_strength"]) for r in graph.strength(e, node.union(nodes_of(spark, [("z", "Z", "", "")]))).collect()}
    assert s["z"] == (0.0, 0.0) and s["v"] == (0.5, pytest.approx(2.02))


def test_pagerank_and_betweenness(spark):
    node = nodes_of(spark, [(c, c, "", "") for c in "abcd"])
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 3.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    x = np.full(4, 0.25)
    p = np.array([[0, 0.25, 0.75, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0]])
    for _ in range(200):
        x = 0.85 * (x @ p + x[3] / 4) + 0.15 / 4
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(e, node, tolerance=1e-12).collect()}
    assert [got[c] for c in "abcd"] == pytest.approx(x.tolist(), abs=1e-9)
    between = {r["id"]: r["betweenness"] for r in graph.betweenness(e, node).collect()}
    assert between == {"a": 0.0, "b": pytest.approx(2 / 6), "c": pytest.approx(2 / 6), "d": 0.0}
    assert graph.pagerank(e.limit(0), node).collect() == []


def test_gate(spark):
    p = prices(spark, A=[1.0, 2.0, 2.0, 2.0], B=[1.0, 1.0, 2.0, 1.0], C=[None] * 4)
    e = spark.createDataFrame([("A", "B", 1.0, "k"), ("A", "C", 1.0, "k")], "src string, dst string, weight double, kinds string")
    detail = propagation.evaluate_predictions(p, panel.log_returns(p), edges=e, threshold=0.5, horizon=1)
    assert [(r["shock_ticker"], r["target"], r["hit"]) for r in detail.collect()] == [("A", "B", True)]
    rolling = e.withColumn("as_of", F.lit(D[1])).union(e.withColumn("as_of", F.lit(D[0])).where("dst = 'C'"))
    assert propagation.evaluate_predictions(p, panel.log_returns(p), rolling=rolling, threshold=0.5).collect() == []
    empty = propagation.gate_summary(detail.limit(0)).first()
    assert empty["n_predictions"] == 0 and empty["hit_rate"] is None
    with pytest.raises(ValueError):
        propagation.evaluate_predictions(p, p)


def test_split_and_spikes(spark):
    rows = spark.createDataFrame([(D[0], 0.01, 0.0336), (D[1], 0.01, 0.0335), (D[2], 0.0, 1.0)], "date date, target_vol double, fwd_return double")
    assert [r["spike"] for r in panel.spike_labels(rows).orderBy("date").collect()] == [1, 0]
    a, b = propagation.temporal_split(rows, str(D[1]))
    assert (a.count(), b.count()) == (1, 2)
    a, b = propagation.temporal_split(rows, str(D[1]), inclusive=True)
    assert (a.count(), b.count()) == (2, 2)
    assert propagation.temporal_split(rows, str(D[2]), embargo_days=1)[0].count() == 1


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "score double, label int")
    assert models.auc(rows).first()["auc"] == pytest.approx(3.5 / 4)
    assert models.auc(rows.where("label = 1")).first()["auc"] is None
    assert models.accuracy(rows).first()[0] == 0.75


def test_lexicon_and_signal(spark):
    rows = [("Profit up, loss; strong", 0.5), ("", 0.0), (None, 0.0), ("Élan profit", 1.0)]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").select("k", tx.polarity("t").alias("p")).orderBy("k").collect()
    assert [r["p"] for r in got] == [v for _, v in rows]
    assert len(tx.POSITIVE) == 36 and len(tx.NEGATIVE) == 42 and not set(tx.POSITIVE) & set(tx.NEGATIVE)
    scored = spark.createDataFrame([("T", "2024-01-01", -1.0), ("T", "2024-01-01", 0.0), ("T", "2024-01-01", 0.5), (None, "2024-01-01", 1.0), ("T", None, 1.0)], "ticker string, date string, polarity double")
    r = news.daily_signal(scored.withColumn("date", F.to_date("date"))).collect()
    assert [tuple(x)[2:] for x in r] == [(3, pytest.approx(-1 / 6), pytest.approx(1 / 3), -1.0, 1.0)]


def test_names(spark):
    cases = {"Tata Motors Ltd": "tata motors", "X Corp Ltd": "x", "X Ltd Corp": "x ltd", "Dr. Reddy's Laboratories": "dr reddys laboratories"}
    got = spark.createDataFrame([(c,) for c in cases], "n string").select("n", tx.normalise_name("n").alias("k")).collect()
    assert {r["n"]: r["k"] for r in got} == cases
    assert len(companies()) == 50 and len({g for *_, g in companies() if g}) == 7
    wanted = {"tatamotors": "TATAMOTORS.NS", "reliance": None, "Infosys Limited": "INFY.NS"}
    found = news.resolve(spark.createDataFrame([(m,) for m in wanted], "mention string"), names(universe(spark))).collect()
    assert {r["mention"]: r["ticker"] for r in found} == wanted
    docs = spark.createDataFrame([(1, "Shares of Tata Motors and Infosys rose"), (2, "none here"), (3, None)], "k int, text string")
    assert {r["k"]: r["tickers"] for r in news.mentions(docs, names(universe(spark)), "k").collect()} == {1: ["INFY.NS", "TATAMOTORS.NS"]}


def test_group_evidence_of_the_universe(spark):
    u = universe(spark).select(F.col("ticker").alias("id"), "name", "sector", F.coalesce("grp", F.lit("")).alias("grp"))
    assert graph.group_evidence(u).count() == 32


def test_top_k_and_novelty(spark):
    v = {"a": [1.0, 0.0], "b": [0.9, sqrt(1 - 0.81)], "c": [0.5, -sqrt(0.75)], "z": [0.0, 0.0]}
    df = spark.createDataFrame([(t, D[0], x) for t, x in v.items()], "ticker string, date date, embedding array<double>")
    got = {(r["a"], r["b"]): r["similarity"] for r in news.propose_edges(df, 1, 0.3).collect()}
    assert got == {("a", "b"): pytest.approx(0.9), ("a", "c"): pytest.approx(0.5)}
    novelty = {r["ticker"]: r["news_novelty"] for r in news.daily_novelty(df).collect()}
    assert novelty["a"] == pytest.approx(0) and novelty["z"] == 1.0
    sectors = spark.createDataFrame([("a", "s"), ("b", "s")], "ticker string, sector string")
    assert tuple(news.proposal_diagnostics(news.propose_edges(df, 1, 0.3), sectors).first()) == (2, 1, 1)


def test_announcements(spark):
    body = '{"Table": [{"NEWSID": "1", "SCRIP_CD": 5, "DT_TM": "2024-03-01T10:00:00", "HEADLINE": " Up ", "NEWSSUB": "x", "PDFFLAG": 1, "ATTACHMENTNAME": "f.pdf"}, {"NEWSID": "2", "NEWS_DT": "bad"}], "Table1": [{"ROWCNT": 2}]}'
    rows = ann.from_responses(spark.createDataFrame([("T", body)], "ticker string, json string"), attachments="https://x/").orderBy("news_id").collect()
    assert rows[0].asDict() == {"news_id": "1", "ticker": "T", "scrip_code": "5", "date": dt.date(2024, 3, 1), "headline": "Up", "subject": "x", "text": "Up x", "category": "", "subcategory": "", "has_pdf": True, "pdf_url": "https://x/f.pdf"}
    assert (rows[1]["date"], rows[1]["text"], rows[1]["has_pdf"], rows[1]["pdf_url"]) == (None, "", False, "")
    many = spark.createDataFrame([("a", 2, D[0]), ("a", 1, D[1]), (None, 3, D[0]), (None, 4, None)], "news_id string, seq int, date date")
    kept = ann.first_of_each(many).collect()
    assert sorted(r["seq"] for r in kept) == [1, 3]
    assert [tuple(r) for r in ann.per_year(many).collect()] == [(2024, 3)]


def test_panels_round_trip(spark, tmp_path):
    p = prices(spark, X=[1.0, None, 3.0], Y=[4.0, 5.0, 6.0])
    back = panels.from_wide(panels.to_wide(p))
    assert back.count() == 5
    panels.save_prices(back, str(tmp_path / "p"))
    assert panels.load_prices(spark, str(tmp_path / "p")).count() == 5
    with pytest.raises(FileNotFoundError):
        panels.load_prices(spark, str(tmp_path / "none"))
    node = nodes_of(spark, [("u", "U", None, "")])
    edges = graph.fold(edges_of(spark, [("u", "u", "b", 1.0), ("u", "u", "a", 1.0)]))
    text = graphs.graphml(node, edges)
    assert "a,b" in text and text.count("<edge ") == 1
    graphs.save_graph(node, edges, str(tmp_path / "g"))
    assert graphs.load_graph(spark, str(tmp_path / "g"))[1].first()["weight"] == 2.0


def test_streams(spark, tmp_path):
    from weftline.streaming.signals import daily_signal_stream, shock_stream

    prices(spark, X=[1.0, 2.0, 2.0, 1.0]).coalesce(1).write.parquet(str(tmp_path / "p"))
    q = shock_stream(spark.readStream.schema("date date, ticker string, price double").parquet(str(tmp_path / "p")), 0.5).writeStream.format("memory").queryName("shocks").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["date"], round(r["magnitude"], 6)) for r in spark.table("shocks").orderBy("date").collect()] == [(D[1], round(log(2), 6)), (D[3], round(-log(2), 6))]
    rows = [("T", dt.datetime(2024, 1, 1, 5), 0.5), ("T", dt.datetime(2024, 1, 1, 9), -0.5), ("T", dt.datetime(2024, 1, 9), 0.0)]
    spark.createDataFrame(rows, "ticker string, ts timestamp, polarity double").coalesce(1).write.parquet(str(tmp_path / "s"))
    q = daily_signal_stream(spark.readStream.schema("ticker string, ts timestamp, polarity double").parquet(str(tmp_path / "s"))).writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["date"], r["news_count"]) for r in spark.table("days").collect()} == {(D[0], 2), (dt.date(2024, 1, 9), 1)}


def test_planned_operators_raise(spark):
    from weftline.operators import planned

    none = spark.createDataFrame([], ann.DOCUMENT)
    for call in (lambda: planned.run_backtest(none, none), lambda: planned.performance_metrics(none, none), lambda: planned.information_content(none), lambda: planned.fetch_documents("news")):
        with pytest.raises(NotImplementedError):
            call()
    assert ann.extract_relations(none).columns == ["src", "dst", "relation", "confidence"] and ann.extract_relations(none).count() == 0


def test_auc_by_groups_and_odd_scores(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), float(s), int(rng.random() < 0.4)) for g in range(3) for s in np.round(rng.normal(0, 1, 80), 1)]
    rows += [(1, float("inf"), 1), (1, float("-inf"), 0), (2, 1e308, 1), (2, -1e308, 0)]
    got = {r["g"]: r["auc"] for r in models.auc(spark.createDataFrame(rows, "g int, score double, label int"), by=("g",)).collect()}
    for g in range(3):
        pos, neg = ([s for h, s, y in rows if h == g and y == k] for k in (1, 0))
        want = np.mean([[float(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
        assert abs(got[g] - want) < 1e-12


def test_permuted_features_keep_their_values(spark, monkeypatch):
    rows = [(float(k), float(k % 7), k % 2) for k in range(90)]
    df = spark.createDataFrame(rows, "x double, z double, y int")
    seen = []
    monkeypatch.setattr(models, "score", lambda model, d: seen.append(d) or d.withColumn("score", F.col("x") + 0.0))
    got = models.permutation_importance(None, df, ["x", "z"], "y", repeats=3, block_rows=20).collect()
    assert {r["feature"] for r in got} == {"x", "z"} and got[-1]["importance"] == 0.0
    for d, c in zip(seen[1:], ("x", "z"), strict=True):
        for k in range(3):
            part = d.where(f"__repeat = {k}").toPandas()
            assert sorted(part[c]) == sorted(df.toPandas()[c]) and (part[c].values != df.toPandas()[c].values).any()
            other = "z" if c == "x" else "x"
            assert sorted(zip(part[other], part["y"], strict=True)) == sorted(zip(df.toPandas()[other], df.toPandas()["y"], strict=True))


def test_false_discoveries_equal_the_definition(spark):
    rng = np.random.default_rng(3)
    for alpha in (0.05, 0.3):
        p = [*np.round(rng.random(60) ** 3, 3), 0.0, 0.0, 1e-300, alpha, float("nan"), None]
        df = spark.createDataFrame([(k, None if x is None else float(x)) for k, x in enumerate(p)], "k int, p double")
        order = sorted((x, k) for k, x in enumerate(p) if x is not None and x == x)
        top = max((i for i, (x, _) in enumerate(order, 1) if x <= alpha * i / len(p)), default=0)
        assert {r["k"] for r in pairstats.bh_reject(df, "p", alpha).where("reject").collect()} == {k for _, k in order[:top]}


def test_closest_names_over_blocks(spark):
    names = spark.createDataFrame([("A", "Alpha Trading"), ("B", "alpha trading"), ("C", "Alfa Tradings"), ("D", "Omega"), ("E", None)], "ticker string, name string")
    said = spark.createDataFrame([("Alpha Trading Ltd",), ("Alphaa Trading",), ("Omegas",), ("Zzz",), (None,)], "mention string")
    for block in (1, 20_000):
        got = {r["mention"]: r["ticker"] for r in news.resolve(said, names, block=block).collect()}
        assert got == {"Alpha Trading Ltd": "B", "Alphaa Trading": "B", "Omegas": "D", "Zzz": None, None: None}


def test_signals_round_trip(spark, tmp_path):
    rows = spark.sql("select 'T' as ticker, date'2024-01-02' as date, 3L as news_count, 0.25D as news_novelty")
    signals.save(rows, "news_semantic", str(tmp_path))
    assert signals.load(spark, "news_semantic", str(tmp_path)).collect() == rows.collect()
    edges = spark.sql("select 'a' as a, 'b' as b, 0.5D as similarity")
    signals.save(edges, "candidate_edges", str(tmp_path))
    assert signals.load(spark, "candidate_edges", str(tmp_path)).collect() == edges.collect()


def test_text_models_and_dense_embedding(spark):
    df = spark.createDataFrame([(1, "gain gain loss"), (2, None), (3, "")], "k int, t string")
    longest = tx.model_polarity(lambda: lambda texts: [float(len(x)) for x in texts], batch=2)
    assert [r[0] for r in df.orderBy("k").select(longest("t")).collect()] == [14.0, 0.0, 0.0]
    pair = tx.model_embedding(lambda: lambda texts: [[len(x), 1] for x in texts])
    assert [list(r[0]) for r in df.orderBy("k").select(pair("t")).collect()] == [[14.0, 1.0], [0.0, 1.0], [0.0, 1.0]]
    dense = [list(r[0]) for r in df.orderBy("k").select(tx.lexical_embedding("t")).collect()]
    assert all(len(d) == 512 for d in dense) and sorted(round(x, 6) for x in dense[0] if x) == [0.447214, 0.894427] and not any(dense[1] + dense[2])
    sparse = {r["bucket"]: r["weight"] for r in tx.term_buckets(df, "k", "t").where("k = 1").collect()}
    assert {k: x for k, x in enumerate(dense[0]) if x} == pytest.approx(sparse)


def test_plans_hold_no_global_window_over_rows_and_no_nested_loop(spark):
    tests = spark.range(10).selectExpr("id as a", "id as b", "rand() as p")
    rows = spark.range(40).selectExpr("date'2024-01-01' + int(id % 10) as date", "string(id % 4) as ticker", "double(id) as price")
    plans = [pairstats.te_tests(rows.withColumnRenamed("price", "r")), pairstats.cointegrated_pairs(rows)]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text
        # one-row counts are the only inputs of nested loops
        assert all("n_tickers" in x for x in re.findall(r"BroadcastNestedLoopJoin[^\n]*\n(?:[^\n]*\n){0,12}", text))
    text = pairstats.bh_reject(tests)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window \[[^\n]*windowspecdefinition\(v#\d+ ASC", text)


def test_confirmed_graph_document(spark, tmp_path):
    node = spark.createDataFrame([(k, k.lower(), "S", "") for k in "ABC"], "id string, name string, sector string, grp string")
    edges = spark.sql("select 'A' as src, 'B' as dst, 0.5D as weight, 0.6D as similarity, 0.01D as coint_p, 0.02D as te_p union all select 'B', 'A', 0.9D, 0.9D, 0.0D, 0.0D")
    assert [r["weight"] for r in graph.strongest(edges, 1).collect()] == [0.9]
    for path in (f"{tmp_path}/c.graphml", f"file://{tmp_path}/d.graphml"):
        graphs.write_confirmed(node, edges, path)
        with open(path.removeprefix("file://"), encoding="utf-8") as f:
            text = f.read()
        assert text.count("<node ") == 2 and text.count("<edge ") == 2 and 'attr.name="coint_p"' in text
