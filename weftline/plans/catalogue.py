"""The registered queries of the analytics, each with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import DEFAULTS
from weftline.functions import text as tx
from weftline.operators import correlation, graph, models, news, pairstats, panel, propagation
from weftline.operators.lineage import cut
from weftline.plans import sql, views
from weftline.sources import announcements as ann
from weftline.sources.universe import names, universe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: the weekly panel moves far more than daily prices do
SHOCK = 1.0
RHO = 0.1
TE = 0.055
SPLIT = "1996-06-03"
#: 52 weeks are the year that 252 days are; no window of them has the 250 observations of a daily panel
YEAR = replace(DEFAULTS, min_obs=40)
POSITIVE, NEGATIVE = ["the", "of", "der", "la"], ["and", "to", "die", "de"]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(c if isinstance(c, Column) else F.col(c), 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# --- panel -----------------------------------------------------------------


@query("weekly_panel", sql.weekly_panel())
def weekly_panel(spark, d):
    return rounded(views.weekly_prices(spark, d))


@query("dense_panel_gaps", sql.dense_panel_gaps())
def dense_panel_gaps(spark, d):
    return panel.densify(views.weekly_prices(spark, d)).where("price is null").select("date", "ticker")


@query("log_returns", sql.log_returns())
def log_returns(spark, d):
    return rounded(panel.log_returns(views.weekly_prices(spark, d)))


@query("forward_returns", sql.forward_returns())
def forward_returns(spark, d):
    return rounded(panel.forward_returns(views.weekly_prices(spark, d), 5))


@query("forward_at_calendar", sql.forward_at_calendar())
def forward_at_calendar(spark, d):
    return rounded(panel.forward_at(views.weekly_prices(spark, d), 5))


@query("trailing_vol", sql.trailing_vol())
def trailing_vol(spark, d):
    return rounded(panel.trailing_vol(panel.dense_returns(views.weekly_prices(spark, d))).select("date", "ticker", "vol"))


@query("market_return_vol", sql.market_return_vol())
def market_return_vol(spark, d):
    return rounded(panel.market(panel.dense_returns(views.weekly_prices(spark, d))).select("date", "mkt_return", "mkt_vol"))


@query("detect_shocks", sql.detect_shocks(SHOCK))
def detect_shocks(spark, d):
    return rounded(panel.shocks(panel.log_returns(views.weekly_prices(spark, d)), SHOCK))


@query("time_slice_tail", sql.time_slice_tail(SPLIT))
def time_slice_tail(spark, d):
    p = panel.time_slice(views.weekly_prices(spark, d), end=SPLIT)
    return rounded(panel.tail(p, 8)).select("date", "ticker", "price")


@query("dead_tickers", sql.dead_tickers())
def dead_tickers(spark, d):
    early = panel.time_slice(views.weekly_prices(spark, d), end="1992-01-06")
    return panel.dead_tickers(early, views.brand_universe(spark, d))


@query("listwise_dates", sql.listwise_dates())
def listwise_dates(spark, d):
    return panel.listwise(panel.log_returns(views.weekly_prices(spark, d)), "r").select("date").distinct()


@query("pairwise_overlap", sql.pairwise_overlap())
def pairwise_overlap(spark, d):
    return panel.pairs(views.weekly_prices(spark, d), "price").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


# --- pair statistics ---------------------------------------------------------


@query("correlation_matrix", sql.correlation_matrix())
def correlation_matrix(spark, d):
    return rounded(correlation.correlations(panel.log_returns(views.weekly_prices(spark, d))))


@query("correlated_pairs", sql.correlated_pairs(RHO))
def correlated_pairs(spark, d):
    return rounded(correlation.correlated_pairs(panel.log_returns(views.weekly_prices(spark, d)), RHO))


@query("hedge_ratio_ols", sql.hedge_ratio_ols())
def hedge_ratio_ols(spark, d):
    return rounded(pairstats.hedge_ratios(views.weekly_prices(spark, d)))


@query("dickey_fuller_lag0", sql.dickey_fuller_lag0())
def dickey_fuller_lag0(spark, d):
    return rounded(pairstats.dickey_fuller(views.weekly_prices(spark, d)))


@query("cointegrated_pairs")
def cointegrated_pairs(spark, d):
    return pairstats.cointegrated_pairs(views.weekly_prices(spark, d))


@query("te_discretise", sql.te_discretise())
def te_discretise(spark, d):
    common = panel.listwise(panel.log_returns(views.weekly_prices(spark, d)), "r")
    return pairstats.binned(common).select("ticker", "date", "bin")


@query("transfer_entropy_pairs", sql.transfer_entropy_pairs())
def transfer_entropy_pairs(spark, d):
    return rounded(pairstats.transfer_entropies(panel.log_returns(views.weekly_prices(spark, d))))


@query("te_significant_pairs")
def te_significant_pairs(spark, d):
    return pairstats.significant_te_pairs(panel.log_returns(views.weekly_prices(spark, d)))


@query("te_shift_tests", sql.te_shift_tests())
def te_shift_tests(spark, d):
    """Transfer entropy with p-values from a stated list of circular shifts; ``te_significant_pairs`` draws 200."""
    shifts = spark.createDataFrame([(k,) for k in sql.SHIFTS], "k int")
    return rounded(pairstats.shifted_tests(panel.log_returns(views.weekly_prices(spark, d)), shifts))


@query("bh_fdr", sql.bh_fdr())
def bh_fdr(spark, d):
    c = correlation.correlations(panel.log_returns(views.weekly_prices(spark, d)))
    tests = c.select("a", "b", r6(F.exp(-F.col("n") * F.col("rho") * F.col("rho") / 2)).alias("p"))
    return pairstats.bh_reject(tests, "p", 0.5)


@query("kalman_hedge", sql.kalman_hedge())
def kalman_hedge(spark, d):
    pair = spark.createDataFrame([("Brand#11", "Brand#12")], "a string, b string")
    return rounded(pairstats.kalman_hedges(views.weekly_prices(spark, d), pair, log=True))


@query("kalman_hedge_pairs")
def kalman_hedge_pairs(spark, d):
    """Every pair of tickers; ``kalman_hedge`` is the one pair that its recursive SQL follows."""
    p = views.weekly_prices(spark, d)
    a = panel.tickers(p).select(F.col("ticker").alias("a"))
    every = a.join(a.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return rounded(pairstats.kalman_hedges(p, every, log=True))


# --- graphs --------------------------------------------------------------------


def brand_nodes(spark, d) -> DataFrame:
    return graph.nodes(views.weekly_prices(spark, d), views.brand_universe(spark, d))


def brand_evidence(spark, d) -> DataFrame:
    """Group, correlation and transfer-entropy evidence of the brands."""
    returns = panel.log_returns(views.weekly_prices(spark, d))
    near = correlation.correlated_pairs(returns, RHO).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("correlation").alias("kind"), F.col("rho").alias("weight"))
    te = graph.te_evidence(pairstats.transfer_entropies(returns).where(F.round("te", 6) >= TE))
    return graph.group_evidence(brand_nodes(spark, d)).unionByName(near).unionByName(te)


def brand_edges(spark, d) -> DataFrame:
    return graph.fold(brand_evidence(spark, d))


@query("graph_nodes", sql.graph_nodes())
def graph_nodes(spark, d):
    return brand_nodes(spark, d)


@query("group_edges", sql.group_edges())
def group_edges(spark, d):
    return graph.group_evidence(brand_nodes(spark, d))


@query("evidence_edges", sql.evidence_edges(RHO, TE))
def evidence_edges(spark, d):
    return rounded(brand_edges(spark, d).select("src", "dst", "weight", graph.kinds().alias("kinds"), F.size("evidence").cast("long").alias("n_evidence")))


@query("edge_correlations", sql.edge_correlations(RHO, TE))
def edge_correlations(spark, d):
    corr = correlation.correlations(panel.log_returns(views.weekly_prices(spark, d)))
    return rounded(graph.with_correlation(brand_edges(spark, d), corr).select("src", "dst", "corr"))


@query("node_strength", sql.node_strength(RHO, TE))
def node_strength(spark, d):
    return rounded(graph.strength(brand_edges(spark, d), brand_nodes(spark, d)))


@query("hidden_linkages", sql.hidden_linkages(RHO, TE))
def hidden_linkages(spark, d):
    return rounded(graph.hidden_linkages(brand_edges(spark, d), brand_nodes(spark, d)))


@query("pagerank_k", sql.pagerank_k(RHO, TE, 20))
def pagerank_k(spark, d):
    return rounded(graph.pagerank(brand_edges(spark, d), brand_nodes(spark, d), tolerance=0.0, most=20))


@query("centrality_table")
def centrality_table(spark, d):
    return graph.centrality(cut(brand_edges(spark, d)), brand_nodes(spark, d))


@query("plot_table", sql.plot_table(RHO, TE))
def plot_table(spark, d):
    return rounded(graph.plot_table(brand_edges(spark, d), brand_nodes(spark, d)).withColumn("colour", F.col("colour").cast("long")))


@query("graph_asof_corr", sql.rolling_graph_corr(52, 13, RHO, SPLIT))
def graph_asof_corr(spark, d):
    when = spark.createDataFrame([(SPLIT,)], "x string").select(F.col("x").cast("date").alias("as_of"))
    return rounded(graph.rolling_correlation_edges(views.weekly_prices(spark, d), when, 52, RHO))


@query("rolling_graph_corr", sql.rolling_graph_corr(52, 13, RHO))
def rolling_graph_corr(spark, d):
    p = views.weekly_prices(spark, d)
    return rounded(graph.rolling_correlation_edges(p, graph.grid(p, 52, 13), 52, RHO))


def full_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight", graph.kinds().alias("kinds"), "corr")


@query("graph_asof_full")
def graph_asof_full(spark, d):
    """All evidence of the window of ``graph_asof_corr``."""
    p = cut(views.weekly_prices(spark, d))
    _, edges = graph.graph_as_of(p, views.brand_universe(spark, d), SPLIT, 52, YEAR)
    return full_edges(edges).select(F.lit(SPLIT).cast("date").alias("as_of"), "*")


@query("rolling_graph_full")
def rolling_graph_full(spark, d):
    """All evidence of every window of ``rolling_graph_corr``; each graph is kept before the next is made."""
    p, brands = cut(views.weekly_prices(spark, d)), views.brand_universe(spark, d).persist()
    out = spark.createDataFrame([], "as_of date, src string, dst string, weight double, kinds string, corr double")
    for as_of, _, edges in graph.rolling_graphs(p, brands, 52, 13, YEAR):
        out = out.union(cut(full_edges(edges).select(F.lit(as_of).cast("date").alias("as_of"), "*")))
    return out


@query("statistical_graph")
def statistical_graph(spark, d):
    p = views.weekly_prices(spark, d)
    _, edges = graph.statistical_graph(p, panel.log_returns(p), views.brand_universe(spark, d))
    return edges.select("src", "dst", "weight", graph.kinds().alias("kinds"), "corr")


def brand_candidates(spark, d) -> DataFrame:
    """Proposed edges (a, b, similarity) between brands, each standing for the vectors of its number."""
    brands = panel.tickers(views.weekly_prices(spark, d)).select(F.col("ticker").alias("brand"), "ord")
    near = news.propose_edges(views.vectors(spark, d), 3, -1.0)
    to = lambda c: brands.select(F.concat(F.lit("T"), "ord").alias(c), F.col("brand").alias(f"brand_{c}"))
    return near.join(to("a"), "a").join(to("b"), "b").select(F.col("brand_a").alias("a"), F.col("brand_b").alias("b"), "similarity")


@query("confirm_edges")
def confirm_edges(spark, d):
    """The strongest 20 of the edges that both families of tests confirm."""
    p = views.weekly_prices(spark, d)
    return graph.strongest(graph.confirm_edges(brand_candidates(spark, d), p, panel.log_returns(p)))


@query("confirm_edges_either")
def confirm_edges_either(spark, d):
    p = views.weekly_prices(spark, d)
    return graph.strongest(graph.confirm_edges(brand_candidates(spark, d), p, panel.log_returns(p), require="or"))


@query("confirm_stored_tests", sql.confirm_stored_tests())
def confirm_stored_tests(spark, d):
    """Correction, weights and order of ``confirm_edges`` over p-values that any engine can compute."""
    c = correlation.correlations(panel.log_returns(views.weekly_prices(spark, d)))
    tests = brand_candidates(spark, d).join(c, ["a", "b"])
    up, size = F.col("rho") >= 0, F.abs("rho")
    tests = tests.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("dst"), F.col("a").alias("x"), F.col("b").alias("y"), "similarity", r6(F.exp(-80 * size)).alias("coint_p"), r6(F.exp(-60 * size)).alias("te_p"))
    found = graph.confirmed(tests, 0.5)
    return graph.strongest(rounded(found))


# --- propagation and models ----------------------------------------------------


def _group_graph(spark, d) -> DataFrame:
    return graph.fold(graph.group_evidence(brand_nodes(spark, d))).select("src", "dst", "weight", graph.kinds().alias("kinds"))


def gate(spark, d) -> DataFrame:
    p = views.weekly_prices(spark, d)
    return propagation.evaluate_predictions(p, panel.log_returns(p), edges=_group_graph(spark, d), threshold=SHOCK, start=SPLIT)


@query("shock_gate_detail", sql.shock_gate_detail(SHOCK, SPLIT))
def shock_gate_detail(spark, d):
    return rounded(gate(spark, d))


@query("shock_gate_summary", sql.shock_gate_summary(SHOCK, SPLIT))
def shock_gate_summary(spark, d):
    return rounded(propagation.gate_summary(gate(spark, d)))


@query("hit_rate_by_kind", sql.hit_rate_by_kind(SHOCK, SPLIT))
def hit_rate_by_kind(spark, d):
    return rounded(propagation.hit_rate_by_kind(gate(spark, d)))


@query("best_targets", sql.best_targets(SHOCK, SPLIT))
def best_targets(spark, d):
    return rounded(propagation.best_targets(gate(spark, d)))


@query("walk_forward_gate", sql.walk_forward_gate(SHOCK, 52, 13, RHO))
def walk_forward_gate(spark, d):
    p = views.weekly_prices(spark, d)
    rolling = graph.rolling_correlation_edges(p, graph.grid(p, 52, 13), 52, RHO)
    edges = rolling.select("as_of", F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("rho").alias("weight"), F.lit("correlation").alias("kinds"))
    return rounded(propagation.evaluate_predictions(p, panel.log_returns(p), rolling=edges, threshold=SHOCK))


def _news(spark, d) -> DataFrame:
    """A daily signal for the brands, from the documents, on the panel's dates."""
    p = views.weekly_prices(spark, d)
    days, brands = panel.calendar(p).withColumnRenamed("date", "day"), panel.tickers(p).withColumnRenamed("ticker", "brand")
    docs = views.announcements(spark, d).withColumn("polarity", tx.polarity("text", POSITIVE, NEGATIVE))
    rows = docs.join(days, F.col("news_id") % 300 == F.col("day_idx")).join(brands, F.col("news_id") % 25 == F.col("ord"))
    return news.daily_signal(rows.select(F.col("brand").alias("ticker"), F.col("day").alias("date"), "polarity"))


def features(spark, d, with_news: bool = False, threshold: float = SHOCK) -> DataFrame:
    p = views.weekly_prices(spark, d)
    edges = graph.with_correlation(brand_edges(spark, d), correlation.correlations(panel.log_returns(p)))
    node = brand_nodes(spark, d)
    ranks = graph.pagerank(edges, node, tolerance=0.0, most=20)
    return propagation.build_dataset(p, edges, node, threshold, news=_news(spark, d) if with_news else None, pagerank=ranks)


@query("feature_matrix", sql.feature_matrix(SHOCK, RHO, TE, 20))
def feature_matrix(spark, d):
    return rounded(features(spark, d))


@query("feature_matrix_news", sql.feature_matrix(SHOCK, RHO, TE, 20, news=(POSITIVE, NEGATIVE)))
def feature_matrix_news(spark, d):
    return rounded(features(spark, d, True))


@query("spike_labels", sql.spike_labels(SHOCK, RHO, TE, 20))
def spike_labels(spark, d):
    return panel.spike_labels(rounded(features(spark, d))).select("date", "source", "target", "spike")


@query("auc_exact", sql.auc_exact(DEFAULTS.shock_threshold, RHO, TE, 20))
def auc_exact(spark, d):
    """Over the shocks of the default threshold: the means of larger tables never move by SHOCK."""
    return rounded(models.auc(rounded(features(spark, d, threshold=DEFAULTS.shock_threshold)), "edge_weight", "target_up"))


def model_features(spark, d, with_news: bool = False) -> tuple[DataFrame, DataFrame]:
    """The feature matrix of all evidence, cointegration with it, before and from SPLIT; kept in a few partitions for repeated passes.

    Shocks are those of the default threshold: the means of larger tables never move by SHOCK.
    """
    p, node = cut(views.weekly_prices(spark, d)), brand_nodes(spark, d).persist()
    found = brand_evidence(spark, d).unionByName(graph.cointegration_evidence(pairstats.cointegrated_pairs(p)))
    edges = cut(graph.with_correlation(graph.fold(found), correlation.correlations(panel.log_returns(p))))
    rows = propagation.build_dataset(p, edges, node, news=_news(spark, d) if with_news else None)
    return propagation.temporal_split(cut(rows.coalesce(4)), SPLIT)


@query("logreg_spike")
def logreg_spike(spark, d):
    train, test = (panel.spike_labels(x) for x in model_features(spark, d))
    model = models.logistic(train, list(propagation.FEATURES), "spike", balanced=True)
    scored = models.score(model, test)
    return models.auc(scored, label="spike").crossJoin(models.accuracy(scored, label="spike"))


@query("gbt_direction")
def gbt_direction(spark, d):
    train, test = model_features(spark, d)
    scored = models.score(models.boosted(train, list(propagation.FEATURES), "target_up"), test)
    return models.auc(scored, label="target_up").crossJoin(models.accuracy(scored, label="target_up"))


@query("news_lift")
def news_lift(spark, d):
    train, test = model_features(spark, d, True)
    return models.news_lift(train, test, list(propagation.FEATURES), list(propagation.NEWS))


@query("permutation_importance")
def permutation_importance(spark, d):
    train, test = model_features(spark, d)
    model = models.boosted(train, list(propagation.FEATURES), "target_up")
    return models.permutation_importance(model, test, list(propagation.FEATURES), "target_up")


# --- texts ------------------------------------------------------------------------


@query("lexicon_polarity", sql.lexicon_polarity(POSITIVE, NEGATIVE))
def lexicon_polarity(spark, d):
    return rounded(views.announcements(spark, d).select("news_id", tx.polarity("text", POSITIVE, NEGATIVE).alias("polarity"), tx.polarity("text").alias("default_polarity")))


def signal(spark, d) -> DataFrame:
    return news.daily_signal(views.announcements(spark, d).withColumn("polarity", tx.polarity("text", POSITIVE, NEGATIVE)))


@query("daily_news_signal", sql.daily_news_signal(POSITIVE, NEGATIVE))
def daily_news_signal(spark, d):
    return rounded(signal(spark, d))


@query("most_negative_days", sql.most_negative_days(POSITIVE, NEGATIVE))
def most_negative_days(spark, d):
    return news.most_negative(rounded(signal(spark, d)), 5)


@query("signal_describe", sql.signal_describe(POSITIVE, NEGATIVE))
def signal_describe(spark, d):
    return rounded(panel.describe(signal(spark, d), "news_sentiment"))


@query("news_coverage", sql.news_coverage(POSITIVE, NEGATIVE))
def news_coverage(spark, d):
    days = views.announcements(spark, d).select("date").distinct()
    grid = days.crossJoin(views.announcements(spark, d).select("ticker").distinct())
    return rounded(news.coverage(grid.join(signal(spark, d), ["ticker", "date"], "left").na.fill(0, ["news_count"])))


@query("dedupe_announcements", sql.dedupe_announcements())
def dedupe_announcements(spark, d):
    rows = views.read(spark, d, "events").select(F.col("user_id").alias("news_id"), F.col("event_id").alias("seq"), "event_type", F.col("ts").cast("date").alias("date"))
    return ann.first_of_each(rows)


@query("announcements_per_year", sql.announcements_per_year())
def announcements_per_year(spark, d):
    rows = views.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return ann.per_year(rows).select(F.col("year").cast("long").alias("year"), "n")


@query("distinct_tickers", sql.distinct_tickers())
def distinct_tickers(spark, d):
    return views.announcements(spark, d).agg(F.count_distinct("ticker").alias("n_tickers"), F.count(F.lit(1)).alias("n_rows"))


@query("flatten_announcement_json", sql.flatten_announcement_json())
def flatten_announcement_json(spark, d):
    e = views.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    stamp = F.when(F.col("event_id") % 5 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("event_id").cast("string").alias("NEWSID"),
                    F.col("user_id").cast("string").alias("SCRIP_CD"),
                    stamp.alias("DT_TM"),
                    F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("HEADLINE"),
                    F.col("k").alias("NEWSSUB"),
                    F.when(F.col("event_id") % 2 == 0, F.lit("1")).alias("PDFFLAG"),
                    F.when(F.col("event_id") % 3 == 0, F.concat("k", F.lit(".pdf"))).alias("ATTACHMENTNAME"),
                )
            ).alias("Table")
        )
    )
    pages = e.select(F.col("event_type").alias("ticker"), body.alias("json"))
    return ann.from_responses(pages, attachments="https://files.example.org/").drop("category", "subcategory")


@query("company_centroids", sql.company_centroids())
def company_centroids(spark, d):
    return rounded(news.centroid_parts(views.vectors(spark, d))).select("ticker", F.col("pos").cast("long").alias("pos"), "v")


@query("daily_novelty", sql.daily_novelty())
def daily_novelty(spark, d):
    return rounded(news.daily_novelty(views.vectors(spark, d)))


@query("propose_edges", sql.propose_edges(3, 0.0))
def propose_edges(spark, d):
    return rounded(news.propose_edges(views.vectors(spark, d), 3, 0.0))


@query("propose_diagnostics", sql.propose_diagnostics(3, 0.0))
def propose_diagnostics(spark, d):
    v = views.vectors(spark, d)
    sectors = v.select("ticker").distinct().withColumn("sector", F.expr("substring(ticker, 2)").cast("int") % 3)
    return news.proposal_diagnostics(news.propose_edges(v, 3, 0.0), sectors)


@query("lexical_embedding_md5", sql.lexical_embedding_md5())
def lexical_embedding_md5(spark, d):
    rows = tx.term_buckets(views.announcements(spark, d), "news_id", "text", stop=("the", "and"))
    return rounded(rows.withColumn("bucket", F.col("bucket").cast("long")))


@query("lexical_embedding_dense", sql.lexical_embedding_dense())
def lexical_embedding_dense(spark, d):
    rows = views.announcements(spark, d).select("news_id", F.posexplode(tx.lexical_embedding("text")).alias("bucket", "weight")).where("weight <> 0")
    return rounded(rows.withColumn("bucket", F.col("bucket").cast("long")))


@query("normalise_names", sql.normalise_names())
def normalise_names(spark, d):
    suffix = F.element_at(F.array(*[F.lit(s) for s in sql.SUFFIX_CASES]), (F.col("s_suppkey") % len(sql.SUFFIX_CASES) + 1).cast("int"))
    rows = views.read(spark, d, "supplier").select("s_suppkey", F.concat("s_name", suffix).alias("raw"))
    return rows.select("s_suppkey", "raw", tx.normalise_name("raw").alias("name"))


@query("resolve_exact", sql.resolve_exact())
def resolve_exact(spark, d):
    names = views.read(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("ticker"), F.col("n_name").alias("name"))
    c = views.read(spark, d, "customer").join(views.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mention = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.upper("n_name"), F.lit(" Ltd"))).when(F.col("c_custkey") % 3 == 1, F.lower("n_name")).otherwise(F.col("c_name"))
    return news.resolve_exact(c.select("c_custkey", mention.alias("mention")), names)


@query("resolve_fuzzy")
def resolve_fuzzy(spark, d):
    wanted = tx.span_rows(views.announcements(spark, d)).distinct()
    return news.resolve(wanted, names(universe(spark)))


@query("mentions_exact", sql.mentions_exact())
def mentions_exact(spark, d):
    """Which texts mention what another text begins with: its first two words, as a name."""
    docs = views.announcements(spark, d)
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    known = docs.select(F.concat(F.lit("D"), "news_id").alias("ticker"), F.array_join(F.slice(w, 1, 2), " ").alias("name")).where("name <> ''")
    return news.mentions(docs, known, "news_id", cutoff=None).select("news_id", F.array_join("tickers", ",").alias("tickers"))


@query("company_mentions")
def company_mentions(spark, d):
    return news.mentions(views.announcements(spark, d), names(universe(spark)), "news_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shocks, group edges and forward returns: where a shock was followed, and where it wasn't."""
    return shock_gate_detail(spark, sf_dir)
