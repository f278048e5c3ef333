"""The same queries as SQL text, composed of shared common table expressions."""

from __future__ import annotations

from weftline.functions.text import NEGATIVE, POSITIVE, SUFFIXES
from weftline.operators.propagation import FEATURES, NEWS

CTE = {
    "prices": """select p_brand as ticker, cast(date_trunc('week', l_shipdate) as date) as date,
        cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as price
        from lineitem join part on l_partkey = p_partkey group by 1, 2""",
    "cal": "select date, row_number() over (order by date) - 1 as day_idx from (select distinct date from prices)",
    "dense": """select c.date, c.day_idx, t.ticker, p.price from cal c cross join (select distinct ticker from prices) t
        left join prices p on p.date = c.date and p.ticker = t.ticker""",
    "moves": "select *, lag(price) over (partition by ticker order by day_idx) as before from dense",
    "rets": "select date, day_idx, ticker, price, case when before > 0 and price > 0 then ln(price / before) end as r from moves",
    "fwd": """select date, ticker, case when lead(price) over w is not null
        then coalesce(lead(price, 5) over w, last_value(price) over (partition by ticker order by date rows between current row and unbounded following)) / price - 1 end as fwd
        from prices window w as (partition by ticker order by date)""",
    "nearest": """select date, ticker, min(case when price is not null then date end) over (partition by ticker order by day_idx
        rows between current row and unbounded following) as at from dense""",
    "fwd_at": "select n.date, n.ticker, f.fwd from nearest n left join fwd f on f.ticker = n.ticker and f.date = n.at",
    "vols": "select date, ticker, coalesce(stddev_samp(r) over (partition by ticker order by day_idx rows between 59 preceding and current row), 0) as vol from rets",
    "mean_returns": "select date, day_idx, avg(r) as m from rets where day_idx > 0 group by 1, 2",
    "market": """select date, coalesce(m, 0) as mkt_return, coalesce(case when count(m) over w = 60 then stddev_samp(m) over w end, 0) as mkt_vol
        from mean_returns window w as (order by day_idx rows between 59 preceding and current row)""",
    "have": "select date, ticker, r from rets where r is not null",
    "full_dates": "select date from have group by date having count(*) = (select count(distinct ticker) from have)",
    "common": "select * from have where date in (select date from full_dates)",
    "full_prices": "select * from prices where date in (select date from prices group by date having count(*) = (select count(distinct ticker) from prices))",
    "corr": """select a.ticker as a, b.ticker as b, count(*) as n,
        covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0) as rho
        from have a join have b on a.date = b.date and a.ticker < b.ticker group by 1, 2""",
    "ols": """select a.ticker as a, b.ticker as b, count(*) as n, regr_intercept(a.price, b.price) as alpha, regr_slope(a.price, b.price) as beta
        from full_prices a join full_prices b on a.date = b.date and a.ticker < b.ticker group by 1, 2""",
    "bins": """select ticker, date, row_number() over (partition by ticker order by date) as pos,
        least(floor(row_number() over (partition by ticker order by r, date) * 4 / count(*) over (partition by ticker)), 3) as bin from common""",
    "steps": "select * from (select *, lag(bin) over (partition by ticker order by pos) as past from bins) where past is not null",
    "cells": """select s.ticker as src, d.ticker as dst, d.bin as yt, d.past as yp, s.past as xp, count(*) as c
        from steps s join steps d on s.date = d.date and s.ticker <> d.ticker group by all""",
    "h3": "select src, dst, sum(c) as n, sum(c * ln(c)) as s from cells group by 1, 2",
    "h2": "select src, dst, sum(c * ln(c)) as s from (select src, dst, yt, yp, sum(c) as c from cells group by all) group by 1, 2",
    "hx": "select src, dst, sum(c * ln(c)) as s from (select src, dst, yp, xp, sum(c) as c from cells group by all) group by 1, 2",
    "h1": "select src, dst, sum(c * ln(c)) as s from (select src, dst, yp, sum(c) as c from cells group by all) group by 1, 2",
    "te": """select h3.src, h3.dst, greatest(0, (h3.s - h2.s - hx.s + h1.s) / h3.n) as te from h3
        join h2 using (src, dst) join hx using (src, dst) join h1 using (src, dst)""",
    "brands": """select ticker, 'Company ' || ticker as name, 'S' || (k % 5) as sector, 'G' || (k % 7) as grp
        from (select distinct p_brand as ticker, cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) as k from part)""",
    "nodes": """select p.ticker as id, coalesce(name, p.ticker) as name, coalesce(sector, 'Unknown') as sector, coalesce(grp, '') as grp
        from (select distinct ticker from prices) p left join brands b on b.ticker = p.ticker""",
    "grouped": "select a.id as src, b.id as dst, 'same_group' as kind, cast(1 as double) as weight from nodes a join nodes b on a.grp = b.grp and a.id <> b.id where a.grp <> ''",
    "strengths": """select id, coalesce(o.w, 0) as out_strength, coalesce(i.w, 0) as in_strength from nodes
        left join (select src, sum(weight) as w from edges group by 1) o on o.src = id
        left join (select dst, sum(weight) as w from edges group by 1) i on i.dst = id""",
    "anns": "select doc_id as news_id, source as ticker, date '2024-01-01' + cast(doc_id % 30 as int) as date, text from documents",
    "tokens": "select *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda w: w <> '') as ws from anns",
    "vecs": "select vec_id, 'T' || label as ticker, date '2024-01-01' + cast(vec_id % 20 as int) as date, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings",
    "cent": "select ticker, pos, avg(cast(x as double)) as v from vecs group by 1, 2",
    "unit": "select ticker, pos, case when n = 0 then 0 else v / n end as v from (select *, sqrt(sum(v * v) over (partition by ticker)) as n from cent)",
    "sims": "select a.ticker as a, b.ticker as b, sum(a.v * b.v) as similarity from unit a join unit b on a.pos = b.pos and a.ticker < b.ticker group by 1, 2",
}
NEEDS = {
    "cal": ["prices"],
    "dense": ["cal"],
    "moves": ["dense"],
    "rets": ["moves"],
    "fwd": ["prices"],
    "nearest": ["dense"],
    "fwd_at": ["nearest", "fwd"],
    "vols": ["rets"],
    "mean_returns": ["rets"],
    "market": ["mean_returns"],
    "have": ["rets"],
    "full_dates": ["have"],
    "common": ["full_dates"],
    "full_prices": ["prices"],
    "corr": ["have"],
    "ols": ["full_prices"],
    "bins": ["common"],
    "steps": ["bins"],
    "cells": ["steps"],
    "h3": ["cells"],
    "h2": ["cells"],
    "hx": ["cells"],
    "h1": ["cells"],
    "te": ["h3", "h2", "hx", "h1"],
    "nodes": ["prices", "brands"],
    "grouped": ["nodes"],
    "tokens": ["anns"],
    "cent": ["vecs"],
    "unit": ["cent"],
    "sims": ["unit"],
}


def _with(names: list[str], body: str, **more: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for k in NEEDS.get(n, []):
            add(k)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} as materialized ({CTE[n]})" for n in order] + [f"{n} as materialized ({q})" for n, q in more.items()]
    return f"with {', '.join(parts)} {body}"


def r6(column: str, alias: str | None = None) -> str:
    return f"round({column}, 6) + 0.0 as {alias or column}"


def weekly_panel() -> str:
    return _with(["prices"], f"select date, ticker, {r6('price')} from prices")


def dense_panel_gaps() -> str:
    return _with(["dense"], "select date, ticker from dense where price is null")


def log_returns() -> str:
    return _with(["have"], f"select date, ticker, {r6('r')} from have")


def forward_returns() -> str:
    return _with(["fwd"], f"select date, ticker, {r6('fwd')} from fwd")


def forward_at_calendar() -> str:
    return _with(["fwd_at"], f"select date, ticker, {r6('fwd')} from fwd_at")


def trailing_vol() -> str:
    return _with(["vols"], f"select date, ticker, {r6('vol')} from vols")


def market_return_vol() -> str:
    return _with(["market"], f"select date, {r6('mkt_return')}, {r6('mkt_vol')} from market")


def detect_shocks(threshold: float) -> str:
    return _with(["have"], f"select ticker, date, {r6('r', 'magnitude')} from have where abs(r) >= {threshold}")


def time_slice_tail(end: str) -> str:
    return _with(["prices"], f"""select date, ticker, {r6('price')} from prices where date <= date '{end}' and date in
        (select distinct date from prices where date <= date '{end}' order by date desc limit 8)""")


def dead_tickers() -> str:
    return _with(["prices", "brands"], "select ticker from brands where ticker not in (select ticker from prices where date <= date '1992-01-06')")


def listwise_dates() -> str:
    return _with(["full_dates"], "select date from full_dates")


def pairwise_overlap() -> str:
    return _with(["prices"], "select a.ticker as a, b.ticker as b, count(*) as n from prices a join prices b on a.date = b.date and a.ticker < b.ticker group by 1, 2")


def correlation_matrix() -> str:
    return _with(["corr"], f"select a, b, n, {r6('rho')} from corr")


def correlated_pairs(threshold: float) -> str:
    return _with(["corr"], f"select a, b, {r6('rho')} from corr where abs(rho) >= {threshold}")


def hedge_ratio_ols() -> str:
    return _with(["ols"], f"select a, b, n, {r6('alpha')}, {r6('beta')} from ols")


def dickey_fuller_lag0() -> str:
    e = """select o.a, o.b, x.date, x.price - o.alpha - o.beta * y.price as e from ols o
        join full_prices x on x.ticker = o.a join full_prices y on y.ticker = o.b and y.date = x.date"""
    d = "select a, b, before, e - before as d from (select *, lag(e) over (partition by a, b order by date) as before from e) where before is not null"
    s = "select a, b, count(*) as n, sum(before * before) as s11, sum(before * d) as s12, sum(d * d) as s22 from d group by 1, 2"
    return _with(["ols"], f"select a, b, n, {r6('s12 / s11 / sqrt((s22 - s12 / s11 * s12) / ((n - 1) * s11))', 'tau')} from s", e=e, d=d, s=s)


def te_discretise() -> str:
    return _with(["bins"], "select ticker, date, cast(bin as int) as bin from bins")


def transfer_entropy_pairs() -> str:
    return _with(["te"], f"select src, dst, {r6('te')} from te")


#: circular shifts of the tests by resampling
SHIFTS = [7 + 16 * k for k in range(19)]


def te_shift_tests() -> str:
    base = "select ticker, r, row_number() over (partition by ticker order by date) - 1 as pos, count(*) over (partition by ticker) as n from common"
    ks = ", ".join(f"({k})" for k in (0, *SHIFTS))
    dealt = f"select b.*, k, (pos + k) % n as sp from base b cross join (values {ks}) v(k)"
    coded = "select ticker, k, sp, least(floor(row_number() over (partition by ticker, k order by r, sp) * 4 / n), 3) as bin from dealt"
    step = "select * from (select *, lag(bin) over (partition by ticker, k order by sp) as past from coded) where past is not null"
    cell = "select s.ticker as src, d.ticker as dst, s.k, d.bin as yt, d.past as yp, s.past as xp, count(*) as c from step s join step d on d.k = 0 and s.sp = d.sp and s.ticker <> d.ticker group by all"
    part = lambda keys: f"select src, dst, k, sum(c * ln(c)) as s, sum(c) as n from (select src, dst, k, {keys}, sum(c) as c from cell group by all) group by all"
    tests = """select a.src, a.dst, a.k, round(greatest(0, (a.s - b.s - d.s + e.s) / a.n), 9) as te from e3 a
        join e2 b using (src, dst, k) join ex d using (src, dst, k) join e1 e using (src, dst, k)"""
    body = f"""select src, dst, {r6('z.te', 'te')}, {r6('(count(*) filter (t.te >= z.te) + 1) / (count(*) + 1)', 'p')} from tests t
        join (select src, dst, te from tests where k = 0) z using (src, dst) where t.k <> 0 group by src, dst, z.te"""
    return _with(["common"], body, base=base, dealt=dealt, coded=coded, step=step, cell=cell, e3=part("yt, yp, xp"), e2=part("yt, yp"), ex=part("yp, xp"), e1=part("yp"), tests=tests)


def bh_fdr() -> str:
    t = f"select a, b, {r6('exp(-n * rho * rho / 2)', 'p')} from corr"
    ranked = "select *, row_number() over (order by p, a, b) as k, count(*) over () as m from t"
    return _with(["corr"], "select a, b, p, k <= coalesce((select max(k) from ranked where p <= 0.5 * k / m), 0) as reject from ranked", t=t, ranked=ranked)


def kalman_hedge() -> str:
    obs = """select row_number() over (order by x.date) as t, x.date, ln(x.price) as y, ln(z.price) as x from prices x
        join prices z on x.date = z.date where x.ticker = 'Brand#11' and z.ticker = 'Brand#12'"""
    q, noise = 1e-4 / (1 - 1e-4), 1e-3
    step = f"""select 0::bigint as t, null::date as date, 0::double as alpha, 0::double as beta, 1::double as c11, 1::double as c12, 1::double as c21, 1::double as c22,
            0::double as spread, 0::double as residual
        union all
        select t, date, alpha + k1 * e, beta + k2 * e, p11 - k1 * v1, c12 - k1 * v2, c21 - k2 * v1, p22 - k2 * v2, e, y - (alpha + k1 * e) - (beta + k2 * e) * x
        from (select *, g1 / s as k1, g2 / s as k2 from (
            select o.t, o.date, o.x, o.y, f.alpha, f.beta, f.c12, f.c21, f.c11 + {q} as p11, f.c22 + {q} as p22, o.y - f.alpha - f.beta * o.x as e,
                f.c11 + {q} + f.c12 * o.x as g1, f.c21 + (f.c22 + {q}) * o.x as g2, f.c11 + {q} + o.x * f.c21 as v1, f.c12 + o.x * (f.c22 + {q}) as v2,
                f.c11 + {q} + f.c12 * o.x + o.x * (f.c21 + (f.c22 + {q}) * o.x) + {noise} as s
            from f join obs o on o.t = f.t + 1))"""
    head = _with(["prices"], "", obs=obs).replace("with ", "with recursive ", 1)
    values = ", ".join(r6(c) for c in ("alpha", "beta", "spread", "residual"))
    return f"{head}, f as ({step}) select 'Brand#11' as a, 'Brand#12' as b, date, {values} from f where t > 0"


def _evidence(rho: float, te: float) -> dict[str, str]:
    return {
        "evidence": f"""select src, dst, kind, weight from grouped union all select a, b, 'correlation', rho from corr where abs(rho) >= {rho}
            union all select src, dst, 'transfer_entropy', te from te where round(te, 6) >= {te}""",
        "edges": """select src, dst, sum(abs(weight)) as weight, array_to_string(list_sort(list(distinct kind)), ',') as kinds, count(*) as n_evidence,
            max(case kind when 'transfer_entropy' then 1 else 0 end) as has_te, max(case kind when 'same_group' then 1 else 0 end) as has_group from evidence group by 1, 2""",
    }


GRAPH = ["grouped", "corr", "te"]


def graph_nodes() -> str:
    return _with(["nodes"], "select id, name, sector, grp from nodes")


def group_edges() -> str:
    return _with(["grouped"], "select * from grouped")


def evidence_edges(rho: float, te: float) -> str:
    return _with(GRAPH, f"select src, dst, {r6('weight')}, kinds, n_evidence from edges", **_evidence(rho, te))


EDGE_CORR = "select e.*, c.rho as corr from edges e left join corr c on c.a = least(e.src, e.dst) and c.b = greatest(e.src, e.dst)"


def edge_correlations(rho: float, te: float) -> str:
    return _with(GRAPH, f"select src, dst, {r6('corr')} from ec", **_evidence(rho, te), ec=EDGE_CORR)


def node_strength(rho: float, te: float) -> str:
    return _with(GRAPH, f"select id, {r6('out_strength')}, {r6('in_strength')} from strengths", **_evidence(rho, te), strengths=CTE["strengths"])


def hidden_linkages(rho: float, te: float) -> str:
    return _with(GRAPH, f"""select src, dst, {r6('weight')}, kinds, x.sector as sector_a, y.sector as sector_b from edges
        join nodes x on x.id = src join nodes y on y.id = dst where has_te = 1 and x.sector <> y.sector and not (x.grp = y.grp and x.grp <> '')""", **_evidence(rho, te))


def _ranks(k: int) -> dict[str, str]:
    out = {
        "n": "select count(*) as n from nodes",
        "total": "select src, sum(weight) as total from edges group by 1",
        "share": "select e.src, e.dst, e.weight / t.total as p from edges e join total t on t.src = e.src",
        "x0": "select id, 1.0 / n as x from nodes, n",
    }
    for i in range(k):
        out[f"x{i + 1}"] = f"""select v.id, 0.85 * (coalesce(g.got, 0) + lost.lost / n.n) + 0.15 / n.n as x from nodes v cross join n
            cross join (select coalesce(sum(x), 0) as lost from x{i} where id not in (select src from total)) lost
            left join (select s.dst, sum(x.x * s.p) as got from x{i} x join share s on s.src = x.id group by 1) g on g.dst = v.id"""
    return out


def pagerank_k(rho: float, te: float, k: int) -> str:
    return _with(GRAPH, f"select id, {r6('x', 'pagerank')} from x{k}", **_evidence(rho, te), **_ranks(k))


def plot_table(rho: float, te: float) -> str:
    return _with(GRAPH, f"""select v.id, string_split(name, ' ')[1] as label, {r6('out_strength + in_strength', 'degree')}, {r6('300 + 250 * (out_strength + in_strength)', 'size')},
        (dense_rank() over (order by sector) - 1) % 20 as colour from nodes v join strengths s on s.id = v.id""", **_evidence(rho, te), strengths=CTE["strengths"])


def _rolling(lookback: int, step: int, rho: float, as_of: str | None = None) -> dict[str, str]:
    ends = f"select date as as_of, day_idx as e from cal where day_idx >= {lookback} and (day_idx - {lookback}) % {step} = 0"
    if as_of:
        ends = f"select date '{as_of}' as as_of, max(day_idx) as e from cal where date <= date '{as_of}'"
    return {
        "ends": ends,
        "inside": f"select as_of, r.date, ticker, r from ends join rets r on r.day_idx > e - {lookback} and r.day_idx <= e where r is not null",
        "rolled": """select a.as_of, a.ticker as a, b.ticker as b, count(*) as n, covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0) as rho
            from inside a join inside b on a.as_of = b.as_of and a.date = b.date and a.ticker < b.ticker group by 1, 2, 3""",
        "kept": f"select * from rolled where abs(rho) >= {rho}",
    }


def rolling_graph_corr(lookback: int, step: int, rho: float, as_of: str | None = None) -> str:
    return _with(["rets"], f"select as_of, a, b, n, {r6('rho')} from kept", **_rolling(lookback, step, rho, as_of))


DETAIL = """select e.src as shock_ticker, h.date, e.dst as target, case when h.r > 0 then 1.0::double else -1.0::double end as shock_sign, f.fwd as forward_return,
    (h.r > 0) = (f.fwd > 0) as hit, e.weight as edge_weight, e.kinds as edge_kinds"""


def _gate(threshold: float, start: str) -> dict[str, str]:
    return {
        "edges": "select src, dst, sum(weight) as weight, 'same_group' as kinds from grouped group by 1, 2",
        "detail": f"{DETAIL} from have h join edges e on e.src = h.ticker join fwd_at f on f.ticker = e.dst and f.date = h.date where f.fwd is not null and abs(h.r) >= {threshold} and h.date >= date '{start}'",
    }


def shock_gate_detail(threshold: float, start: str) -> str:
    return _with(["grouped", "have", "fwd_at"], f"select shock_ticker, date, target, shock_sign, {r6('forward_return')}, hit, {r6('edge_weight')}, edge_kinds from detail", **_gate(threshold, start))


def shock_gate_summary(threshold: float, start: str) -> str:
    return _with(["grouped", "have", "fwd_at"], f"""select count(*) as n_predictions, {r6('avg(hit::int)', 'hit_rate')}, 0.5::double as baseline, {r6('avg(hit::int) - 0.5', 'lift')},
        {r6('avg((forward_return > 0)::int)', 'up_rate')} from detail""", **_gate(threshold, start))


def hit_rate_by_kind(threshold: float, start: str) -> str:
    return _with(["grouped", "have", "fwd_at"], f"select edge_kinds, {r6('avg(hit::int)', 'hit_rate')}, count(*) as n from detail group by 1", **_gate(threshold, start))


def best_targets(threshold: float, start: str) -> str:
    return _with(["grouped", "have", "fwd_at"], f"select target, {r6('avg(hit::int)', 'hit_rate')}, count(*) as n from detail group by 1 having count(*) >= 20 order by avg(hit::int) desc, target limit 10", **_gate(threshold, start))


def walk_forward_gate(threshold: float, lookback: int, step: int, rho: float) -> str:
    more = _rolling(lookback, step, rho)
    more["known"] = "select h.date, max(k.as_of) as as_of from (select distinct date from have) h join (select distinct as_of from kept) k on k.as_of < h.date group by 1"
    more["edges"] = "select as_of, a as src, b as dst, abs(rho) as weight, 'correlation' as kinds from kept"
    more["detail"] = f"""{DETAIL} from have h join known k on k.date = h.date join edges e on e.src = h.ticker and e.as_of = k.as_of
        join fwd_at f on f.ticker = e.dst and f.date = h.date where f.fwd is not null and abs(h.r) >= {threshold}"""
    return _with(["have", "fwd_at"], f"select shock_ticker, date, target, shock_sign, {r6('forward_return')}, hit, {r6('edge_weight')}, edge_kinds from detail", **more)


def _features(threshold: float, rho: float, te: float, k: int, news: tuple[list[str], list[str]] | None = None) -> tuple[list[str], dict[str, str]]:
    more = {**_evidence(rho, te), "ec": EDGE_CORR, "strengths": CTE["strengths"], **_ranks(k)}
    extra = joined = ""
    base = [*GRAPH, "fwd_at", "vols", "market"]
    if news:
        base.append("tokens")
        more["scored"] = f"select *, {_polarity(*news)} as polarity from tokens"
        more["dealt"] = """select b.ticker, c.date, polarity from scored s join cal c on c.day_idx = s.news_id % 300
            join (select ticker, row_number() over (order by ticker) - 1 as ord from (select distinct ticker from prices)) b on b.ord = s.news_id % 25"""
        more["signal"] = _signal("dealt")
        extra = ", " + ", ".join(f"coalesce(s.{c}, 0)::double as {c}" for c in NEWS)
        joined = "left join signal s on s.ticker = h.ticker and s.date = h.date"
    more["rows"] = f"""select h.date, e.src as source, e.dst as target, f.fwd as fwd_return, abs(h.r) as shock_abs, case when h.r > 0 then 1.0 else -1.0 end as shock_sign,
        sv.vol as source_vol, e.weight as edge_weight, coalesce(e.corr, 0) as edge_corr, has_te as has_transfer_entropy, 0 as has_cointegration, has_group as has_same_group,
        coalesce(x.x, 0) as target_pagerank, st.in_strength as target_in_strength, st.out_strength as target_out_strength, coalesce(tv.vol, 0) as target_vol,
        coalesce(m.mkt_return, 0) as mkt_return, coalesce(m.mkt_vol, 0) as mkt_vol{extra}, (f.fwd > 0)::int as target_up
        from have h join vols sv on sv.ticker = h.ticker and sv.date = h.date {joined} left join market m on m.date = h.date join ec e on e.src = h.ticker
        join fwd_at f on f.ticker = e.dst and f.date = h.date left join vols tv on tv.ticker = e.dst and tv.date = h.date
        left join x{k} x on x.id = e.dst left join strengths st on st.id = e.dst where abs(h.r) >= {threshold} and f.fwd is not null"""
    columns = [*FEATURES, *(NEWS if news else ())]
    more["features"] = f"select date, source, target, {r6('fwd_return')}, {', '.join(r6(f'{c}::double', c) for c in columns)}, target_up from rows"
    return base, more


def feature_matrix(threshold: float, rho: float, te: float, k: int, news: tuple[list[str], list[str]] | None = None) -> str:
    base, more = _features(threshold, rho, te, k, news)
    return _with(base, "select * from features", **more)


def spike_labels(threshold: float, rho: float, te: float, k: int) -> str:
    base, more = _features(threshold, rho, te, k)
    return _with(base, "select date, source, target, (abs(fwd_return) > 1.5 * (target_vol * sqrt(5)))::int as spike from features where target_vol * sqrt(5) > 0", **more)


def auc_exact(threshold: float, rho: float, te: float, k: int) -> str:
    base, more = _features(threshold, rho, te, k)
    more["ranked"] = "select target_up as y, rank() over (order by edge_weight) + (count(*) over (partition by edge_weight) - 1) / 2.0 as rk from features"
    return _with(base, f"select count(*) as n, sum(y)::bigint as positives, {r6('(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0)::double / (sum(y) * (count(*) - sum(y)))', 'auc')} from ranked", **more)


def _among(words: list[str]) -> str:
    return f"len(list_filter(ws, lambda w: w in ({', '.join(repr(w) for w in words)})))"


def _polarity(positive: list[str], negative: list[str]) -> str:
    p, n = _among(positive), _among(negative)
    return f"coalesce(({p} - {n})::double / nullif({p} + {n}, 0), 0)"


def _signal(table: str) -> str:
    return f"""select ticker, date, count(*) as news_count, avg(polarity) as news_sentiment, avg((polarity < 0)::int) as news_neg_ratio,
        min(polarity) as news_worst, max(abs(polarity)) as news_abs_max from {table} where date is not null and ticker is not null group by 1, 2"""


def lexicon_polarity(positive: list[str], negative: list[str]) -> str:
    return _with(["tokens"], f"select news_id, {r6(_polarity(positive, negative), 'polarity')}, {r6(_polarity(POSITIVE, NEGATIVE), 'default_polarity')} from tokens")


def _signals(positive: list[str], negative: list[str], body: str) -> str:
    return _with(["tokens"], body, scored=f"select *, {_polarity(positive, negative)} as polarity from tokens", signal=_signal("scored"))


SIGNAL = ", ".join(["ticker", "date", "news_count", *(r6(c) for c in NEWS[1:])])


def daily_news_signal(positive: list[str], negative: list[str]) -> str:
    return _signals(positive, negative, f"select {SIGNAL} from signal")


def most_negative_days(positive: list[str], negative: list[str]) -> str:
    return _signals(positive, negative, f"select * from (select {SIGNAL} from signal) order by news_sentiment, ticker, date limit 5")


def signal_describe(positive: list[str], negative: list[str]) -> str:
    c = "news_sentiment"
    return _signals(positive, negative, f"select {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')}, {r6(f'min({c})', 'min')}, {r6(f'max({c})', 'max')} from signal")


def news_coverage(positive: list[str], negative: list[str]) -> str:
    return _signals(positive, negative, f"""select {r6('avg((coalesce(s.news_count, 0) > 0)::int)', 'coverage')} from (select distinct date from anns) d
        cross join (select distinct ticker from anns) t left join signal s on s.ticker = t.ticker and s.date = d.date""")


def dedupe_announcements() -> str:
    return """select user_id as news_id, event_id as seq, event_type, cast(ts as date) as date from events
        qualify row_number() over (partition by user_id order by event_id) = 1"""


def announcements_per_year() -> str:
    return "select year(o_orderdate) as year, count(*) as n from orders where o_orderdate is not null group by 1"


def distinct_tickers() -> str:
    return _with(["anns"], "select count(distinct ticker) as n_tickers, count(*) as n_rows from anns")


def flatten_announcement_json() -> str:
    k = "coalesce(json_extract_string(props, '$.k'), '')"
    return f"""select cast(event_id as varchar) as news_id, event_type as ticker, cast(user_id as varchar) as scrip_code,
        case when event_id % 5 = 0 then null else cast(ts as date) end as date, event_type as headline, {k} as subject, trim(event_type || ' ' || {k}) as text,
        event_id % 2 = 0 as has_pdf, case when event_id % 3 = 0 and {k} <> '' then 'https://files.example.org/' || {k} || '.pdf' else '' end as pdf_url from events"""


def company_centroids() -> str:
    return _with(["unit"], f"select ticker, pos, {r6('v')} from unit")


def daily_novelty() -> str:
    day = "select ticker, date, pos, avg(cast(x as double)) as v from vecs group by 1, 2, 3"
    norm = "select *, sqrt(sum(v * v) over (partition by ticker, date)) as n from day"
    return _with(["unit"], f"""select d.ticker, d.date, (select count(distinct vec_id) from vecs x where x.ticker = d.ticker and x.date = d.date) as news_count,
        {r6('1 - sum(case when d.n = 0 then 0 else d.v / d.n end * u.v)', 'news_novelty')} from norm d join unit u on u.ticker = d.ticker and u.pos = d.pos group by 1, 2""", day=day, norm=norm)


def _proposed(top_k: int, min_sim: float) -> dict[str, str]:
    return {
        "both_ways": "select a, b, similarity from sims union all select b, a, similarity from sims",
        "near": f"select * from (select *, row_number() over (partition by a order by similarity desc, b) as n from both_ways) where n <= {top_k} and similarity >= {min_sim}",
        "proposed": "select least(a, b) as a, greatest(a, b) as b, max(similarity) as similarity from near group by 1, 2",
    }


def propose_edges(top_k: int, min_sim: float) -> str:
    return _with(["sims"], f"select a, b, {r6('similarity')} from proposed", **_proposed(top_k, min_sim))


def propose_diagnostics(top_k: int, min_sim: float) -> str:
    same = "cast(substr(a, 2) as int) % 3 = cast(substr(b, 2) as int) % 3"
    return _with(["sims"], f"select count(*) as n_edges, count(*) filter ({same}) as same_sector, count(*) filter (not ({same})) as cross_sector from proposed", **_proposed(top_k, min_sim))


def confirm_stored_tests() -> str:
    brand = "select ticker, 'T' || (row_number() over (order by ticker) - 1) as t from (select distinct ticker from prices)"
    cand = "select x.ticker as a, y.ticker as b, similarity from proposed p join brand x on x.t = p.a join brand y on y.t = p.b"
    tests = f"""select case when rho >= 0 then a else b end as src, case when rho >= 0 then b else a end as dst, a as x, b as y, similarity,
        {r6('exp(-80 * abs(rho))', 'coint_p')}, {r6('exp(-60 * abs(rho))', 'te_p')} from cand join corr using (a, b)"""
    ranked = "select *, row_number() over (order by coint_p) as kc, row_number() over (order by te_p) as kt, count(*) over () as m from tests"
    cut = lambda p, k: f"{p} <= coalesce((select max({p}) from ranked where {p} <= 0.5 * {k} / m), -1)"
    kept = f"select *, row_number() over (partition by src, dst order by x desc, y desc) as n from ranked where {cut('coint_p', 'kc')} and {cut('te_p', 'kt')}"
    body = f"""select src, dst, {r6('similarity * (1 - greatest(coint_p, te_p))', 'weight')}, {r6('similarity')}, {r6('coint_p')}, {r6('te_p')} from kept where n = 1
        order by round(similarity * (1 - greatest(coint_p, te_p)), 6) desc, src, dst limit 20"""
    return _with(["sims", "corr"], body, **_proposed(3, -1.0), brand=brand, cand=cand, tests=tests, ranked=ranked, kept=kept)


def lexical_embedding_dense() -> str:
    flat = "select news_id, unnest(ws) as w from tokens"
    counts = "select news_id, cast('0x' || substr(md5(w), 1, 8) as bigint) % 512 as bucket, count(*) as c from flat where length(w) > 1 group by 1, 2"
    return _with(["tokens"], f"select news_id, bucket, {r6('c / sqrt(sum(c * c) over (partition by news_id))', 'weight')} from counts", flat=flat, counts=counts)


def lexical_embedding_md5() -> str:
    flat = "select news_id, unnest(ws) as w from tokens"
    counts = "select news_id, cast('0x' || substr(md5(w), 1, 8) as bigint) % 512 as bucket, count(*) as c from flat where length(w) > 1 and w not in ('the', 'and') group by 1, 2"
    return _with(["tokens"], f"select news_id, bucket, {r6('c / sqrt(sum(c * c) over (partition by news_id))', 'weight')} from counts", flat=flat, counts=counts)


SUFFIX_CASES = ["", " Ltd", " Limited", " Corp Ltd", " Ltd Corp", " Inc.", " & Sons PLC", " Ltd."]


def _normal(column: str) -> str:
    out = f"trim(lower({column}))"
    for s in SUFFIXES:
        out = f"trim(regexp_replace({out}, '{s.replace('.', chr(92) + '.')}$', ''))"
    return f"regexp_replace({out}, '[^a-z0-9& ]', '', 'g')"


def normalise_names() -> str:
    cases = ", ".join(f"'{s}'" for s in SUFFIX_CASES)
    raw = f"select s_suppkey, s_name || [{cases}][s_suppkey % {len(SUFFIX_CASES)} + 1] as raw from supplier"
    return f"select s_suppkey, raw, {_normal('raw')} as name from ({raw})"


def resolve_exact() -> str:
    mention = "case when c_custkey % 3 = 0 then upper(n_name) || ' Ltd' when c_custkey % 3 = 1 then lower(n_name) else c_name end"
    return f"""with names as (select {_normal('n_name')} as k, max('N' || n_nationkey) as ticker from nation group by 1),
        m as (select c_custkey, {mention} as mention from customer join nation on c_nationkey = n_nationkey)
        select c_custkey, mention, ticker from m left join names on k = {_normal('mention')}"""


def mentions_exact() -> str:
    said = "select news_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') as w from anns"
    known = f"select {_normal('name')} as k, max('D' || news_id) as ticker from (select news_id, array_to_string(w[1:2], ' ') as name from said) where name <> '' group by 1"
    spans = " union ".join(f"select news_id, array_to_string(w[i:i + {n - 1}], ' ') as m from (select news_id, w, unnest(range(1, len(w) - {n - 2})) as i from said)" for n in range(1, 5))
    hits = f"select distinct news_id, ticker from (select * from spans where regexp_matches(m, '^\\p{{Lu}}')) join known on k = {_normal('m')}"
    return _with(["anns"], "select news_id, string_agg(ticker, ',' order by ticker) as tickers from hits group by 1", said=said, known=known, spans=spans, hits=hits)
