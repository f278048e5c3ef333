"""Registered queries against brute force over whole small tables."""

import datetime as dt
import inspect
import os
import re
from difflib import SequenceMatcher, get_close_matches
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import kernels
from weftline.functions import text as tx
from weftline.operators import graph, models, news, propagation
from weftline.plans import catalogue
from weftline.sources.universe import companies

SF = "/root/testdata/sf0.01"

SUFFIXES = (" limited", " ltd", " ltd.", " corp", " corporation", " inc", " plc")


def plain(name):
    name = name.strip().lower()
    for x in SUFFIXES:
        name = name[: -len(x)].strip() if name.endswith(x) else name
    return re.sub("[^a-z0-9& ]", "", name)


KNOWN = {plain(n): t for t, n, *_ in companies()}


def ticker(mention):
    key = plain(mention)
    near = [key] if key in KNOWN else get_close_matches(key, KNOWN, n=1, cutoff=0.85)
    return KNOWN[near[0]] if near else None


def all_spans(text):
    w = (text or "").split()
    return {" ".join(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1) if w[i][0].isupper()}


def test_mentions_of_whole_documents(spark, tmp_path):
    texts = ["Shares of Tata Consultancy Services and Hindustan Unilevr fell", "Infosys Limited, then Asian Paint Ltd rose", "reliance industries", "Nothing Here", None, "", "Oil & Natural Gas Corp with Dr. Reddy's Laboratories", "Wipros up"]
    rows = [(k, "s", x) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: sorted({t for m in all_spans(x) if (t := ticker(m))}) for k, _, x in rows}
    got = {r["news_id"]: r["tickers"] for r in catalogue.QUERIES["company_mentions"](spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if v} and got[0] == ["HINDUNILVR.NS", "TCS.NS"]
    pairs = catalogue.QUERIES["resolve_fuzzy"](spark, str(tmp_path)).collect()
    assert len(pairs) == len(set().union(*map(all_spans, texts)))
    assert {r["mention"]: r["ticker"] for r in pairs} == {m: ticker(m) for x in texts for m in all_spans(x)}


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@needs_tables
def test_model_features_hold_all_evidence(spark):
    train, test = catalogue.model_features(spark, SF)
    rows = train.union(test)
    kinds = [f"has_{k}" for k in ("transfer_entropy", "cointegration", "same_group")]
    seen = rows.agg(*[F.max(k).alias(k) for k in kinds], F.min("has_same_group").alias("least")).first()
    assert [seen[k] for k in kinds] == [1.0, 1.0, 1.0] and seen["least"] == 0.0
    # every edge of the small feature matrix is among those of all evidence
    edge = ["date", "source", "target"]
    assert catalogue.features(spark, SF).select(edge).exceptAll(rows.select(edge)).isEmpty()


@pytest.mark.parametrize("name, columns", [("gbt_direction", 14), ("permutation_importance", 14), ("news_lift", 19)])
def test_models_are_whole(spark, monkeypatch, name, columns):
    made = {}
    data = spark.createDataFrame([(0,)], "x int")
    monkeypatch.setattr(catalogue, "model_features", lambda *a: (data, data))

    def noted(f, name):
        def call(*args, **kwargs):
            found = inspect.signature(f).bind(*args, **kwargs)
            found.apply_defaults()
            made.setdefault(name, []).append(found.arguments)
            return data

        return call

    fits = noted(models.boosted, "fit")
    monkeypatch.setattr(models, "boosted", fits)
    monkeypatch.setattr(models, "score", lambda model, df: df)
    result = data.selectExpr("0.5D as auc")
    monkeypatch.setattr(models, "auc", lambda *a, **k: result)
    monkeypatch.setattr(models, "accuracy", lambda *a, **k: data)
    monkeypatch.setattr(models, "permutation_importance", noted(models.permutation_importance, "deal"))
    catalogue.QUERIES[name](spark, "")
    assert {x["rounds"] for x in made["fit"]} == {400} and max(len(x["features"]) for x in made["fit"]) == columns
    assert all(x["repeats"] == 8 and x["features"] == list(propagation.FEATURES) for x in made.get("deal", []))
    assert ("deal" in made) == (name == "permutation_importance")


def put_prices(spark, folder, series):
    """Tables whose weekly prices are ``series`` (ticker -> prices, None for a missing week)."""
    names = list(series)
    first = dt.datetime(1994, 1, 3)
    lines = [(k, first + dt.timedelta(weeks=w), float(p), 1.0) for k, t in enumerate(names) for w, p in enumerate(series[t]) if p is not None]
    spark.createDataFrame(lines, "l_partkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")


def test_hedges_of_every_pair(spark, tmp_path):
    rng = np.random.default_rng(5)
    series = {t: [round(float(x), 2) for x in 50 + rng.random(30) * 10] for t in ("Kilo 1", "Lima 2", "Mike 3", "Oscar 4")}
    series["Lima 2"][7] = None
    put_prices(spark, tmp_path, series)
    got = {}
    for r in catalogue.QUERIES["kalman_hedge_pairs"](spark, str(tmp_path)).orderBy("a", "b", "date").collect():
        got.setdefault((r["a"], r["b"]), []).append([r[c] for c in ("alpha", "beta", "spread", "residual")])
    assert set(got) == set(combinations(sorted(series), 2))
    for (a, b), rows in got.items():
        state, cov, want = np.zeros(2), np.ones((2, 2)), []
        for y, x in zip(series[a], series[b], strict=True):
            if y is None or x is None:
                continue
            h = np.array([1.0, np.log(x)])
            cov = cov + np.eye(2) * 1e-4 / (1 - 1e-4)
            spread = np.log(y) - h @ state
            gain = cov @ h / (h @ cov @ h + 1e-3)
            state, cov = state + gain * spread, cov - np.outer(gain, h @ cov)
            want.append([*state, spread, np.log(y) - h @ state])
        assert np.allclose(rows, want, atol=2e-6)


def test_full_graphs_of_windows(spark, tmp_path):
    rng = np.random.default_rng(8)
    common = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 80)))
    series = {"B 1": common, "B 2": common * (1 + rng.normal(0, 0.004, 80)), "B 8": 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 80)))}
    put_prices(spark, tmp_path, {t: [round(float(x), 2) for x in v] for t, v in series.items()})
    weeks = [dt.date(1994, 1, 3) + dt.timedelta(weeks=k) for k in range(80)]
    prices = {t: {w: round(float(x), 2) for w, x in zip(weeks, v, strict=True)} for t, v in series.items()}
    got = {}
    for r in catalogue.QUERIES["rolling_graph_full"](spark, str(tmp_path)).collect():
        got.setdefault(r["as_of"], {})[r["src"], r["dst"]] = (set(r["kinds"].split(",")), r["weight"])
    want = {}
    for end in (52, 65, 78):
        found = want.setdefault(weeks[end], {})
        put = lambda a, b, kind, w: found.setdefault((a, b), []).append((kind, w))  # noqa: B023, E731
        window = weeks[end - 51 : end + 1]
        p = {t: np.array([v[w] for w in window]) for t, v in prices.items()}
        r = {t: np.array([np.log(v[w] / v[w - dt.timedelta(weeks=1)]) for w in window]) for t, v in prices.items()}
        for a, b in (("B 1", "B 8"), ("B 8", "B 1")):  # both are of group G1
            put(a, b, "same_group", 1.0)
        for a, b in combinations(sorted(series), 2):
            if (x := kernels.engle_granger_p(p[a], p[b])) <= 0.05:
                put(a, b, "cointegration", 1 - x)
                put(b, a, "cointegration", 1 - x)
            both = kernels.te_significance(r[a], r[b], 4, 200, 42), kernels.te_significance(r[b], r[a], 4, 200, 42)
            (te, x), s, t = (both[0], a, b) if both[0][0] >= both[1][0] else (both[1], b, a)
            if x <= 0.05:
                put(s, t, "transfer_entropy", te)
    assert set(got) == set(want)
    for day, edges in want.items():
        assert {k: v[0] for k, v in got[day].items()} == {k: {x for x, _ in v} for k, v in edges.items()}
        assert all(abs(got[day][k][1] - sum(w for _, w in v)) < 1e-9 for k, v in edges.items())
    assert any("cointegration" in k for day in got.values() for k, _ in day.values())


@needs_tables
def test_statistical_graph_keeps_all_surrogates(spark, monkeypatch):
    seen = []
    keep = graph.pairstats.significant_te_pairs
    monkeypatch.setattr(graph.pairstats, "significant_te_pairs", lambda rows, alpha, bins, n, seed: seen.append(n) or keep(rows, alpha, bins, n, seed))
    catalogue.QUERIES["statistical_graph"](spark, SF.replace("sf0.01", "sf0.001"))
    assert seen == [200]


def test_auc_of_no_rows(spark):
    """A count of nothing is 0, as in SQL; there are no groups of nothing."""
    rows = spark.createDataFrame([], "g int, score double, label int")
    assert tuple(models.auc(rows).first()) == (0, None, None)
    assert models.auc(rows, by=("g",)).collect() == []


def test_auc_of_small_moves(spark, tmp_path):
    """A panel that moves by a few hundredths has shocks, all of which count."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(4)
    put_prices(spark, tmp_path, {f"B {k}": [round(float(x), 2) for x in 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 90)))] for k in (1, 2, 8)})
    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES["auc_exact"](spark, str(tmp_path)).first()
    assert tuple(got) == c.sql(catalogue.SQL["auc_exact"]).fetchall()[0] and got["n"] > 50


MODELS = {"logreg_spike": [(0, None, None, None)], "gbt_direction": [(0, None, None, None)], "news_lift": [(None, None, None)], "permutation_importance": [(f, None) for f in sorted(propagation.FEATURES)]}


@pytest.mark.parametrize("name", MODELS)
def test_models_without_training_rows(spark, monkeypatch, name):
    columns = [*propagation.FEATURES, *propagation.NEWS]
    rows = spark.createDataFrame([(*[float(k)] * len(columns), 0.1 * k, k % 2) for k in range(1, 5)], ", ".join(f"{c} double" for c in [*columns, "fwd_return"]) + ", target_up int")
    monkeypatch.setattr(catalogue, "model_features", lambda *a: (rows.where("target_up = 2"), rows))
    assert list(map(tuple, catalogue.QUERIES[name](spark, "").collect())) == MODELS[name]


@pytest.mark.parametrize("cutoff", [0.85, 0.5, 1.0])
def test_bounds_lose_no_name(cutoff):
    rng = np.random.default_rng(9)
    known = [*KNOWN, "", "\u00e9 \u00f6\u00fc", "x" * 70]
    words = []
    for _ in range(400):
        w = list(known[rng.integers(len(known))])
        for _ in range(rng.integers(5)):
            i = int(rng.integers(len(w) + 1))
            w[i : i + int(rng.integers(2))] = [str(rng.choice(list("ax7& \u00e9")))] * int(rng.integers(2))
        words.append("".join(w))
    want = {}
    for i, w in enumerate(words):
        best = max((SequenceMatcher(None, k, w).ratio(), k) for k in known)
        if best[0] >= cutoff:
            want[i] = best
    assert news.Closest(known, cutoff).many(pa.array(words)) == want


@pytest.mark.parametrize("name, shuffles", [("company_mentions", 1), ("resolve_fuzzy", 1)])
def test_texts_are_read_once(spark, tmp_path, name, shuffles):
    spark.createDataFrame([(1, "s", "Infosys rose")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == shuffles and "CoGroup" not in plan


ODD = ["\u00c9lan K\u00f6ln \u0416\u0443\u043a", "A  b\tC\n\nD", " Foo", "Bar ", "\u01c5 \u24b6 \u1e9e \U0001d400x", "a\x1cB C\u00a0D \u2028 E", "\u4e1c\u4eac Kilo \u212a \u0130nc", None, "", " \n ", "x"]


def test_spans_in_batches(spark):
    """Spans cut from bytes are those of the column, however texts are put together."""
    rng = np.random.default_rng(6)
    texts = [*ODD, *("".join(rng.choice(list("AB\u00c9\u00e9\u0416c. \t\n"), int(rng.integers(60)))) for _ in range(300))]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    want = {r[0] for r in docs.select(F.explode(tx.spans("text"))).collect()}
    for at_once in (1, 100, 1 << 20):
        assert {r["mention"] for r in tx.span_rows(docs, at_once=at_once).collect()} == want
    assert tx.span_rows(docs.where("text is null")).collect() == []


def test_names_in_batches(spark):
    """Normalised names of a batch are those of the column."""
    rng = np.random.default_rng(7)
    parts = [*SUFFIXES, "Ltd.", " INC", "Oil & Gas", " ", "\n", "\r\n", "\u2028", "\u0085", "K", "\u212a", "\u0130", "\u00e9", "-", "\t", "x7"]
    names = [*ODD, *("".join(rng.choice(parts, int(rng.integers(6)))) for _ in range(2000))]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string").select("i", tx.normalise_name("name").alias("k"))
    want = [r["k"] for r in sorted(rows.collect())]
    assert tx.normalised(pa.array(names)).to_pylist() == want
    assert tx.normalised(pa.array(names)[5:9]).to_pylist() == want[5:9] and tx.normalised(pa.array([], pa.string())).to_pylist() == []


def test_mentions_are_cut_and_normalised_in_batches(spark, tmp_path):
    """No lambda runs over the words of a text, and no chain of patterns over a mention."""
    spark.createDataFrame([(1, "s", "Infosys rose")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.QUERIES["resolve_fuzzy"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "regexp_replace" not in plan and plan.count("MapInArrow") == 2
