"""Registered scalar functions, alerts, exits and composed strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.series import change, ma, ref, staged
from ..operators import alerts as al
from ..operators import cross_section as xs
from ..operators import filings as fl
from ..operators import portfolio as pf
from ..operators.signals import rolling_vwap, typical
from ..operators.windows import rebalance_every
from ..sources.bars import bars, table
from ..sources.panel import panel
from . import sqlkit as q

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(key: str, run, digits: dict[str, int], sql: str | None, plain: tuple[str, ...] = ()) -> None:
    QUERIES[key] = lambda spark, sf_dir: run(spark, sf_dir).select(*plain, *[F.round(c, d).alias(c) for c, d in digits.items()])
    if sql is not None:
        ORACLE_SQL[key] = q.recursive(
            f"WITH {sql.strip()}\nSELECT {', '.join([*plain, *[f'round({c}, {d}) + 0.0 AS {c}' for c, d in digits.items()]])} FROM final"
        )


_DT = ("date", "ticker")
_UNITS = ("HK$ million", "RMB'000", "US$ thousand", "cents")
_unit = lambda: F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
_add(
    "fn04_currency_units",
    lambda s, d: table(s, d, "orders").select("o_orderkey", fl.currency(_unit()).alias("ccy"), fl.unit_scale(_unit()).alias("scale")),
    {},
    "final AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'HKD' WHEN 1 THEN 'CNY' WHEN 2 THEN 'USD' END AS ccy, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'millions' WHEN 3 THEN 'units' ELSE 'thousands' END AS scale FROM orders)",
    ("o_orderkey", "ccy", "scale")
)
_LABELS = ("Equity attributable to owners of the Company", "Non-controlling interests", "Total equity", "Cash and bank balances", "Other matters")
_add(
    "fn05_line_items",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey",
        fl.line_item(F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("code")
    ),
    {},
    "final AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'equity_attributable_to_owners' WHEN 1 THEN 'non_controlling_interests' WHEN 2 "
    "THEN 'total_equity' WHEN 3 THEN 'cash_and_bank_balances' END AS code FROM orders)",
    ("o_orderkey", "code")
)
_add(
    "fn06_last_number",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey",
        fl.last_number(
            F.concat(
                F.lit("Note 12 and "),
                F.when(
                    F.col("o_orderkey") % 2 == 0,
                    F.concat(F.lit("("), F.format_number("o_totalprice", 2), F.lit(")"))
                ).otherwise(F.format_number("o_totalprice", 2))
            )
        ).alias("v")
    ),
    {"v": 2},
    "final AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders)",
    ("o_orderkey",)
)
_add(
    "fn08_fiscal_half",
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("fy"), fl.fiscal_half(F.col("o_orderdate")).alias("half")),
    {},
    "final AS (SELECT o_orderkey, year(o_orderdate) AS fy, CASE WHEN month(o_orderdate) = 6 THEN 'H1' ELSE 'FY' END AS half FROM orders)",
    ("o_orderkey", "fy", "half")
)
_add(
    "fn09_lineage_json",
    lambda s, d: table(s, d, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("j")),
    {},
    "final AS (SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || CAST(n_regionkey AS VARCHAR) || '}' AS j FROM nation)",
    ("n_nationkey", "j")
)
_add(
    "fn10_numeric_coercion",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey",
        F.coalesce(F.regexp_replace("o_orderpriority", "-.*", "").try_cast("double"), F.lit(0.0)).alias("v")
    ),
    {"v": 1},
    "final AS (SELECT o_orderkey, coalesce(try_cast(regexp_replace(o_orderpriority, '-.*', '') AS DOUBLE), 0) AS v FROM orders)",
    ("o_orderkey",)
)
_VW = [
    f"(high + low + close) / 3 AS tp, (high + low + close) / 3 * volume AS pv",
    f"{q.full('sum', 'pv', 5)} AS a, {q.full('sum', 'volume', 5)} AS b"
]
QUERIES["fn12_prices"] = lambda s, d: rolling_vwap(bars(s, d), 5, "vw").withColumn("tp", typical()).select(
    "date",
    "ticker",
    F.round("tp", 7).alias("tp"),
    F.round("vw", 3).alias("vw")
)
ORACLE_SQL["fn12_prices"] = q.stages(q.BRAND, _VW, "SELECT date, ticker, round(tp, 7) + 0.0 AS tp, round(a / nullif(b, 0), 3) + 0.0 AS vw FROM {s}")
_Z = ((0.1, -1.2815515655446004), (0.5, 0.0), (0.9, 1.2815515655446004))


def _target_days(s, d):
    z = s.createDataFrame(_Z, "p double, z double")
    rows = panel(s, d).where("px is not null").groupBy("ticker").agg(F.max_by("px", "date").alias("r0"), F.stddev_samp(F.log("px")).alias("sigma"))
    return rows.crossJoin(F.broadcast(z)).withColumn("days", (F.log(F.col("r0") * 1.2 / F.col("r0")) - F.col("z") * F.col("sigma")) / 0.001)


_add(
    "fn16_days_to_target",
    _target_days,
    {"days": 2},
    f"{q.PANEL}, z(p, z) AS (VALUES {', '.join(f'({p}, {z})' for p, z in _Z)}), r AS (SELECT ticker, max_by(px, date) AS r0, stddev_samp(ln(px)) AS "
    f"sigma FROM panel WHERE px IS NOT NULL GROUP BY ticker), final AS (SELECT ticker, CAST(p AS DOUBLE) AS p, (ln(r0 * 1.2 / r0) - z * sigma) / "
    f"0.001 AS days FROM r CROSS JOIN z)",
    ("ticker", "p")
)
_add(
    "fn17_drift",
    lambda s, d: panel(s, d).where("ret is not null").withColumn("mu", F.log(1 + F.col("ret")) * (252 / 21)),
    {"mu": 4},
    f"{q.PANEL}, final AS (SELECT date, ticker, ln(1 + ret) * 12 AS mu FROM panel WHERE ret IS NOT NULL)",
    _DT
)
_add(
    "flt20_overrides",
    lambda s, d: table(s, d, "orders").select(
        F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("override_id"),
        F.when(F.col("o_orderstatus").isin("O", "F"), F.col("o_orderstatus")).otherwise("pending").alias("status")
    ),
    {},
    "final AS (SELECT sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus) AS override_id, "
    "CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'pending' END AS status FROM orders)",
    ("override_id", "status")
)
_add(
    "jon05_equi_left",
    lambda s, d: table(s, d, "customer").join(
        table(s, d, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.count("*").alias("n")),
        F.col("c_custkey") == F.col("o_custkey"),
        "left"
    ),
    {},
    "o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey), final AS (SELECT c_custkey, n FROM customer "
    "LEFT JOIN o ON c_custkey = o_custkey)",
    ("c_custkey", "n")
)
_SIG = lambda x: 1 / (1 + F.exp(-x))


def _open_score(s, d):
    r = staged(panel(s, d), a=ma("px", 4), b=ma("px", 8), c=ma("px", 16))
    r = r.withColumn("order", _SIG((F.col("a") - F.col("b")) / F.col("px") * 10)).withColumn(
        "tight",
        F.exp(-F.abs(F.col("a") - F.col("c")) / F.col("px"))
    ).withColumn("slope", _SIG((F.col("a") - ref("a")) / F.col("px") * 10))
    return r.withColumn("score4", F.col("order") * F.col("tight") * F.col("slope")).where("score4 is not null")


_add(
    "ind04_open_score",
    _open_score,
    {"score4": 5},
    f"{q.PANEL}, m AS (SELECT *, {q.ma('px', 4)} AS a, {q.ma('px', 8)} AS b, {q.ma('px', 16)} AS c "
    f"FROM panel), k AS (SELECT *, 1 / (1 + exp(-(a - b) / px * 10)) * exp(-abs(a - c) / px) / (1 + exp(-(a - {q.ref('a')}) / px * 10)) AS score4 "
    f"FROM m), final AS (SELECT * FROM k WHERE score4 IS NOT NULL)",
    _DT
)
_add(
    "ind06_cross_strength",
    lambda s, d: staged(
        panel(s, d),
        a=ma("px", 4),
        b=ma("px", 12),
        up=F.coalesce((F.col("a") > F.col("b")) & (ref("a") <= ref("b")), F.lit(False)),
        strength=(F.col("a") - F.col("b")) / F.col("px"),
        vr=F.col("volume") / ma("volume", 8)
    ).where("up").withColumn("s", F.col("strength") * F.col("vr")).where("s is not null"),
    {"s": 6},
    f"{q.PANEL}, m AS (SELECT *, {q.ma('px', 4)} AS a, {q.ma('px', 12)} AS b, volume / ({q.ma('volume', 8)}) AS vr "
    f"FROM panel), k AS (SELECT *, a > b AND {q.ref('a')} <= {q.ref('b')} AS up FROM m), final AS (SELECT date, ticker, (a - b) / px * vr AS s "
    f"FROM k WHERE up AND (a - b) / px * vr IS NOT NULL)",
    _DT
)
_pipeline = lambda d: pf.asset_vol_target(
    pf.hold_weights(
        d,
        pf.allocate(
            xs.top_k(
                staged(
                    d,
                    vol=F.stddev_pop("ret").over(xs.Window.partitionBy("ticker").orderBy("date").rowsBetween(-11, 0))
                ).where("pos % 4 = 0 and vol > 0"),
                "score",
                6
            ).withColumn("leg", F.lit("long")).withColumn("budget", F.lit(1.0)),
            "inv_vol",
            cap=0.3
        ),
        rebalance_every(d.select("date", "pos").distinct(), 4)
    ),
    3.0,
    8,
    1.0,
    52
)
_PIPE = f"""v AS (SELECT *, stddev_pop(ret) {q.w(12)} AS vol FROM panel), t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS place FROM v WHERE score IS NOT NULL AND pos % 4 = 0 AND vol > 0),
a AS (SELECT date, ticker, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS w FROM t WHERE place <= 6), b AS (SELECT *, least(w, 0.3) AS c, CASE WHEN w < 0.3 THEN w ELSE 0 END AS fr FROM a),
c AS (SELECT *, c + coalesce(sum(w - c) OVER (PARTITION BY date) * fr / nullif(sum(fr) OVER (PARTITION BY date), 0), 0) AS c2 FROM b), k AS (SELECT date, ticker, c2 / sum(c2) OVER (PARTITION BY date) AS w FROM c),
w0 AS (SELECT p.*, CASE WHEN p.pos % 4 = 0 THEN coalesce(k.w, 0) END AS wr FROM panel p LEFT JOIN k ON k.date = p.date AND k.ticker = p.ticker), w1 AS (SELECT *, coalesce(last_value(wr IGNORE NULLS) {q.w()}, 0) AS w FROM w0),
x0 AS (SELECT *, w * coalesce(least(3.0 / CASE WHEN ({q.full('stddev_pop', 'ret', 8)}) * sqrt(52) > 1e-12 THEN ({q.full('stddev_pop', 'ret', 8)}) * sqrt(52) END, 1.0), 1) AS ws FROM w1), x1 AS (SELECT *, sum(abs(ws)) OVER (PARTITION BY date) AS gr FROM x0), x2 AS (SELECT *, max(gr) OVER () AS worst FROM x1),
x3 AS (SELECT date, ticker, ret, CASE WHEN worst > 1 AND gr > 0 THEN ws / gr ELSE ws END AS w FROM x2),
b0 AS (SELECT *, coalesce({q.ref('w')}, 0) AS lw, coalesce(abs(w - {q.ref('w')}), 0) AS dw FROM x3), b1 AS (SELECT date, sum(lw * coalesce(ret, 0)) AS gross, sum(abs(lw)) AS exposure, sum(dw) AS turnover FROM b0 GROUP BY date),
b2 AS (SELECT *, coalesce(lag(turnover) OVER (ORDER BY date), 0) * 0.001 AS cost FROM b1)"""
_add(
    "pf04_strategy_pipeline",
    lambda s, d: pf.backtest(_pipeline(panel(s, d)), 0.001),
    {"gross": 5, "net": 5, "exposure": 4},
    f"{q.PANEL}, {_PIPE}, final AS (SELECT *, gross - cost AS net FROM b2)",
    ("date",)
)
_add(
    "pf13_early_exit",
    lambda s, d: (lambda p: al.early_exit(p, p.where("score > 0.3 and px is not null"), 6, "px", 4))(panel(s, d)),
    {"ret": 5},
    f"{q.PANEL}, m AS (SELECT *, {q.ma('px', 4)} AS m FROM panel), e AS (SELECT ticker, pos AS entry, px AS paid FROM panel "
    f"WHERE score > 0.3 AND px IS NOT NULL), p AS (SELECT e.ticker, entry, paid, coalesce(min(CASE WHEN m.px < m.m THEN m.pos END), max(m.pos)) AS "
    f"ex FROM e JOIN m ON m.ticker = e.ticker AND m.pos BETWEEN entry + 1 AND entry + 6 "
    f"GROUP BY e.ticker, entry, paid), final AS (SELECT p.ticker, entry, ex AS exit, panel.px / paid - 1 AS ret FROM p "
    f"JOIN panel ON panel.ticker = p.ticker AND panel.pos = ex)",
    ("ticker", "entry", "exit")
)
_add(
    "pf20_composed_study",
    lambda s, d: (
        lambda r: r.groupBy("ticker").agg(F.avg("pnl").alias("mean"), F.stddev_pop("pnl").alias("std"))
    )(pf.single_asset(staged(panel(s, d), z=-change("px", 8)), F.col("z") > 0.1, 0.001)),
    {"mean": 6, "std": 6},
    f"{q.PANEL}, a AS (SELECT *, CASE WHEN -{q.change('px', 8)} > 0.1 THEN 1.0 ELSE 0.0 END AS sg "
    f"FROM panel), b AS (SELECT *, coalesce({q.ref('sg')}, 0) AS ps FROM a), c AS (SELECT *, ps * coalesce(ret, 0) - 0.001 * abs(ps - "
    f"coalesce({q.ref('ps')}, 0)) AS pnl FROM b), final AS (SELECT ticker, avg(pnl) AS mean, stddev_pop(pnl) AS std FROM c GROUP BY ticker)",
    ("ticker",)
)
_above = lambda d: staged(d, m6=ma("px", 6), up=(F.col("px") > F.col("m6")) & (ref("px") <= ref("m6")))
_CROSS = (
    f"m0 AS (SELECT date, pos, ticker, px, {q.ma('px', 6)} AS m FROM panel), m1 AS (SELECT *, coalesce(px > m AND {q.ref('px')} <= {q.ref('m')}, "
    f"false) AS up, coalesce(px < m, false) AND coalesce({q.ref('px', -1)} < {q.ref('m', -1)}, false) AS fin, max(pos) OVER () - 1 AS bound FROM m0)"
)
_ENDS = (
    "m2 AS (SELECT a.ticker, a.date, a.pos, min(b.pos) AS stop FROM m1 a JOIN m1 b ON b.ticker = a.ticker AND b.pos > a.pos AND b.fin AND b.pos < "
    "b.bound WHERE a.up GROUP BY ALL)"
)
_EPISODES = q.walk(
    "w",
    "m2",
    {"taken": "true", "last": "n.stop"},
    {"taken": "n.pos > s.last + 3", "last": "CASE WHEN n.pos > s.last + 3 THEN n.stop ELSE s.last END"},
    order="pos"
)
_add(
    "reg11_trend_episodes",
    lambda s, d: al.trend_episodes(_above(panel(s, d)), "up", "px", 6, 2, 3).withColumnRenamed("end", "stop"),
    {},
    f"{q.PANEL}, {_CROSS}, {_ENDS}, {_EPISODES}, final AS (SELECT w.ticker, w.date AS start, e.date AS stop, w.stop - w.pos AS n FROM w "
    f"JOIN m0 e ON e.ticker = w.ticker AND e.pos = w.stop WHERE taken)",
    ("ticker", "start", "stop", "n")
)
_HIT = "a0 AS (SELECT date, ticker, coalesce(abs(ret) > 0.4, false) AS hit FROM panel)"
_KEEP = "n.hit AND (s.spot IS NULL OR n.date - s.spot > 30)"
_KEPT = q.walk(
    "ak",
    "a0",
    {"kept": "n.hit", "spot": "CASE WHEN n.hit THEN n.date END"},
    {"kept": _KEEP, "spot": f"CASE WHEN {_KEEP} THEN n.date ELSE s.spot END"}
)
_hits = lambda s, d: panel(s, d).select("date", "ticker", F.coalesce(F.abs("ret") > 0.4, F.lit(False)).alias("hit"))
_add(
    "reg13_alert_collapse",
    lambda s, d: al.collapse_alerts(_hits(s, d), "hit", 30, ["ticker"]).where("kept"),
    {},
    f"{q.PANEL}, {_HIT}, {_KEPT}, final AS (SELECT * FROM ak WHERE kept)",
    _DT
)
_MATCH = lambda tol: q.walk(
    "mt",
    "mv",
    {"alert": "n.c0", "last": "coalesce(n.c0, -1000000)"},
    {
        k: (
            f"(SELECT min(spot) FROM al WHERE al.ticker = n.ticker AND al.spot BETWEEN n.event - {tol} AND n.event + {tol} AND al.spot > s.last)"
        ) for k in ("alert",)
    } | {
        "last": f"coalesce((SELECT min(spot) FROM al WHERE al.ticker = n.ticker AND al.spot BETWEEN n.event - {tol} AND n.event + {tol} AND al.spot > "
        f"s.last), s.last)"
    },
    order="event"
)
_FIRST = (
    lambda tol: f"mv AS (SELECT e.ticker, e.event, min(a.spot) AS c0 FROM ev e LEFT JOIN al a ON a.ticker = e.ticker AND a.spot BETWEEN e.event - {tol} AND "
    f"e.event + {tol} GROUP BY e.ticker, e.event)"
)
_add(
    "jon18_alert_match",
    lambda s, d: al.match_alerts(
        panel(s, d).where("ret > 0.5").select("ticker", "pos"),
        panel(s, d).where("ret < -0.4").select("ticker", "pos"),
        "ticker",
        "pos",
        3
    ),
    {},
    f"{q.PANEL}, ev AS (SELECT ticker, pos AS event FROM panel WHERE ret > 0.5), al AS (SELECT ticker, pos AS spot FROM panel "
    f"WHERE ret < -0.4), {_FIRST(3)}, {_MATCH(3)}, final AS (SELECT ticker, event, alert FROM mt)",
    ("ticker", "event", "alert")
)
_DAY = "CAST(date - DATE '1970-01-01' AS BIGINT)"
_add(
    "reg13_alert_scores",
    lambda s, d: al.score_alerts(_hits(s, d), "hit", panel(s, d).where("score < -0.5").select("ticker", "date"), 7, 30),
    {"mean_delay": 4, "precision": 5, "recall": 5},
    f"{q.PANEL}, {_HIT}, {_KEPT}, ev AS (SELECT ticker, {_DAY} AS event FROM panel WHERE score < -0.5), al AS (SELECT ticker, {_DAY} AS spot "
    f"FROM ak WHERE kept), {_FIRST(7)}, {_MATCH(7)}, tk AS (SELECT DISTINCT ticker FROM panel), ec AS (SELECT ticker, count(*) AS n_events, "
    f"count(alert) AS tp, avg(alert - event) AS mean_delay FROM mt GROUP BY ticker), ac AS (SELECT ticker, count(*) AS n_alerts FROM al "
    f"GROUP BY ticker), cn AS (SELECT ticker, coalesce(n_events, 0) AS n_events, coalesce(n_alerts, 0) AS n_alerts, coalesce(tp, 0) AS tp, "
    f"mean_delay FROM tk LEFT JOIN ec USING (ticker) LEFT JOIN ac USING (ticker)), final AS (SELECT *, n_events - tp AS fn, n_alerts - tp AS fp, "
    f"CAST(tp AS DOUBLE) / nullif(n_alerts, 0) AS precision, CAST(tp AS DOUBLE) / nullif(n_events, 0) AS recall FROM cn)",
    ("ticker", "n_events", "n_alerts", "tp", "fn", "fp")
)
