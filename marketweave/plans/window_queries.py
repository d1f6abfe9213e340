"""Registered window primitives and notebook indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.series import change, cs_rank, ffill, full, ma, ref, rolling_corr, rolling_cov, staged, std, total, trailing
from ..operators import windows as op
from ..operators.signals import ewm
from ..sources.bars import bars, calendar, sparse_bars
from . import sqlkit as q

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(
    key: str,
    build,
    columns: dict[str, int],
    steps: list[str],
    by: str = "brand",
    extra: str = "",
    where: str = "TRUE",
    base: str | None = None
) -> None:
    """Registers build(bars) with date, ticker and the given columns, rounded; steps are the SQL for the same columns."""

    def run(spark, sf_dir):
        out = build(bars(spark, sf_dir, by))
        return out.where(where).select("date", "ticker", *[F.round(c, d).alias(c) if d >= 0 else F.col(c) for c, d in columns.items()])

    QUERIES[key] = run
    if steps is not None:
        chosen = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" if d >= 0 else c for c, d in columns.items())
        ORACLE_SQL[key] = q.stages(base or (q.BRAND if by == "brand" else q.NATION), steps, f"SELECT date, ticker, {chosen} FROM {{s}} WHERE {where}")


_add(
    "win01_lag_lead",
    lambda d: staged(d, prev=ref("close"), next=ref("close", -1)),
    {"prev": 9, "next": 9},
    [f"{q.ref('close')} AS prev, {q.ref('close', -1)} AS next"],
    by="nation"
)
_add(
    "win02_rolling_stats",
    lambda d: staged(
        d,
        m=ma("close", 12, least=6),
        s=std("close", 12, least=6),
        t=total("volume", 12, least=6),
        hi=full(F.max, "close", 12, 6),
        lo=full(F.min, "close", 12, 6)
    ),
    {"m": 4, "s": 4, "t": 2, "hi": 9, "lo": 9},
    [
        f"{q.ma('close', 12, least=6)} AS m, {q.std('close', 12, least=6)} AS s, {q.full('sum', 'volume', 12, 6)} AS t, "
        f"{q.full('max', 'close', 12, 6)} AS hi, {q.full('min', 'close', 12, 6)} AS lo"
    ],
    by="nation",
)
_add(
    "win03_rolling_product",
    lambda d: staged(d, r=1 + change("close"), p=full(F.product, "r", 8)),
    {"p": 4},
    [f"1 + {q.change('close')} AS r", f"{q.full('product', 'r', 8)} AS p"]
)
_add(
    "win04_rolling_cov_corr",
    lambda d: staged(d, cov=rolling_cov("close", "volume", 12), corr=rolling_corr("close", "volume", 12)),
    {"cov": 2, "corr": 4},
    [f"{q.cov('close', 'volume', 12)} AS cov, {q.corr('close', 'volume', 12)} AS corr"]
)
_add("win05_ts_rank", lambda d: op.rolling_rank(d, "volume", 10, "k"), {"k": 6}, [f"{q.ts_rank('volume', 10)} AS k"])
_add("win06_cs_rank", lambda d: staged(d, k=cs_rank("volume")), {"k": 6}, [f"{q.cs_rank('volume')} AS k"], by="nation")

QUERIES["win07_ewm"] = lambda spark, sf: ewm(bars(spark, sf), "close", "e", span=10).select("date", "ticker", F.round("e", 4).alias("e"))
ORACLE_SQL["win07_ewm"] = f"""
WITH RECURSIVE {q.BRAND},
e AS (
  SELECT ticker, pos, date, close AS avg, CAST(1.0 AS DOUBLE) AS wt FROM bars WHERE pos = 0
  UNION ALL
  SELECT b.ticker, b.pos, b.date,
         CASE WHEN b.close IS NULL THEN e.avg WHEN e.avg IS NULL THEN b.close ELSE (e.wt * (1 - 2.0 / 11) * e.avg + 2.0 / 11 * b.close) / (e.wt * (1 - 2.0 / 11) + 2.0 / 11) END,
         CASE WHEN b.close IS NULL AND e.avg IS NOT NULL THEN e.wt * (1 - 2.0 / 11) ELSE 1.0 END
  FROM e JOIN bars b ON b.ticker = e.ticker AND b.pos = e.pos + 1)
SELECT date, ticker, round(avg, 4) + 0.0 AS e FROM e
"""
_add(
    "win08_rolling_ols",
    lambda d: op.rolling_ols(staged(d, y=F.ln("close")), "y", 26),
    {"slope": 6, "r2": 5},
    [
        "ln(close) AS y, CAST(pos AS DOUBLE) AS x",
        f"CASE WHEN count(y) {q.w(26)} = 26 THEN regr_slope(y, x) {q.w(26)} END AS slope, "
        f"CASE WHEN count(y) {q.w(26)} = 26 THEN regr_r2(y, x) {q.w(26)} END AS r2"
    ]
)
_add(
    "win09_rolling_zscore",
    lambda d: staged(d, z=op.zscore("close", 26)),
    {"z": 4},
    [f"(close - ({q.ma('close', 26)})) / nullif({q.std('close', 26)}, 0) AS z"]
)
_add(
    "win10_rolling_sharpe",
    lambda d: staged(d, r=change("close"), s=op.rolling_sharpe("r", 26, 52)),
    {"s": 4},
    [f"{q.change('close')} AS r", f"({q.ma('r', 26)}) / nullif({q.full('stddev_pop', 'r', 26)}, 0) * sqrt(52) AS s"]
)
_add(
    "win11_equity_curve",
    lambda d: staged(d, r=change("close"), e=op.equity("r")),
    {"e": 3},
    [f"{q.change('close')} AS r", f"product(1 + coalesce(r, 0)) {q.w()} AS e"]
)
_add(
    "win12_drawdown",
    lambda d: staged(d, r=change("close"), e=op.equity("r"), dd=op.drawdown("e")),
    {"dd": 5},
    [f"{q.change('close')} AS r", f"product(1 + coalesce(r, 0)) {q.w()} AS e", f"e / max(e) {q.w()} - 1 AS dd"]
)
_add(
    "win14_forward_returns",
    lambda d: staged(d, nc=op.forward_return(2), no=op.forward_return(2, "next_open"), oc=op.forward_return(2, "open_to_close")),
    {"nc": 4, "no": 4, "oc": 4},
    [
        f"{q.div(q.ref('close', -3), q.ref('close', -1))} - 1 AS nc, {q.div(q.ref('open', -3), q.ref('open', -1))} - 1 AS no, "
        f"{q.div(q.ref('close', -2), q.ref('open', -1))} - 1 AS oc"
    ],
    by="nation",
)
_add(
    "win15_forward_compound",
    lambda d: staged(d, r=change("close"), f=op.forward_compound("r", 4)),
    {"f": 4},
    [f"{q.change('close')} AS r", f"CASE WHEN count(*) {q.fw(1, 4)} = 4 THEN exp(sum(ln(1 + coalesce(r, 0))) {q.fw(1, 4)}) - 1 END AS f"]
)
_add(
    "win16_forward_drawdown",
    lambda d: staged(d, dd=op.forward_drawdown("close", 4)),
    {"dd": 5},
    [
        ", ".join(f"{q.ref('close', -i)} AS c{i}" for i in range(5)),
        "CASE WHEN " + " AND ".join(f"c{i} IS NOT NULL" for i in range(5)) + " THEN least(0, " + ", ".join(
            f"c{i} / greatest({', '.join(f'c{j}' for j in range(i + 1))}) - 1" for i in range(1, 5)
        ) + ") END AS dd",
    ]
)
QUERIES["win17_rebalance_grids"] = lambda spark, sf: (
    op.rebalance_every(calendar(sparse_bars(spark, sf, "nation")), 5, 2).select("date", F.lit("every5").alias("rule"))
    .unionByName(op.rebalance_calendar(calendar(sparse_bars(spark, sf, "nation")), "W-FRI").withColumn("rule", F.lit("W-FRI")))
    .unionByName(op.rebalance_calendar(calendar(sparse_bars(spark, sf, "nation")), "M").withColumn("rule", F.lit("M")))
)
ORACLE_SQL["win17_rebalance_grids"] = f"""
WITH {q.NATION}
SELECT date, 'every5' AS rule FROM dates WHERE pos >= 2 AND (pos - 2) % 5 = 0
UNION ALL SELECT max(date), 'W-FRI' FROM dates GROUP BY date_trunc('week', date + INTERVAL 2 DAY)
UNION ALL SELECT max(date), 'M' FROM dates GROUP BY date_trunc('month', date)
"""
_add(
    "win19_ffill_limit",
    lambda d: staged(d, f=ffill("close"), f3=ffill("close", 3)),
    {"f": 9, "f3": 9},
    [f"{q.ffill('close')} AS f, last_value(close IGNORE NULLS) {q.w(3)} AS f3"],
    by="nation"
)
_add(
    "win20_expanding_bins",
    lambda d: staged(op.expanding_rank(d, "volume", 52, "k"), bin=F.least(F.floor(F.col("k") * 10), F.lit(9)).cast("long")),
    {"k": 6, "bin": -1},
    [
        f"list(volume) {q.w()} AS vs, count(volume) {q.w()} AS n",
        "CASE WHEN volume IS NOT NULL AND n >= 52 THEN (len(list_filter(vs, lambda v: v < volume)) + (len(list_filter(vs, lambda v: v = volume)) + "
        "1) / 2.0) / n END AS k",
        "CAST(least(floor(k * 10), 9) AS BIGINT) AS bin",
    ]
)
_add(
    "win21_run_age",
    lambda d: op.with_run_age(staged(d, m=ma("volume", 8), up=F.coalesce(F.col("volume") > F.col("m"), F.lit(False))), "up"),
    {"age": -1},
    [
        f"coalesce(volume > ({q.ma('volume', 8)}), false) AS up",
        f"sum(CASE WHEN up THEN 0 ELSE 1 END) {q.w()} AS g",
        "CAST(CASE WHEN up THEN row_number() OVER (PARTITION BY ticker, g, up ORDER BY date) ELSE 0 END AS INTEGER) AS age"
    ]
)
_add("win22_cusum", lambda d: op.cusum(staged(d, z=op.zscore("volume", 26)).where("z is not null"), "z", 0.5), {"up": 4, "down": 4}, None)
ORACLE_SQL["win22_cusum"] = q.stages(q.BRAND, [f"(volume - ({q.ma('volume', 26)})) / nullif({q.std('volume', 26)}, 0) AS z"], f"""
, f AS (SELECT date, ticker, CASE WHEN lag(z) OVER ({q.TS}) IS NULL THEN 0 ELSE z - 0.5 END AS u, CASE WHEN lag(z) OVER ({q.TS}) IS NULL THEN 0 ELSE -z - 0.5 END AS d FROM {{s}} WHERE z IS NOT NULL),
g AS (SELECT *, sum(u) {q.w()} AS cu, sum(d) {q.w()} AS cd FROM f)
SELECT date, ticker, round(cu - least(0, min(cu) {q.w()}), 4) + 0.0 AS up, round(cd - least(0, min(cd) {q.w()}), 4) + 0.0 AS down FROM g""")
_add(
    "win23_break_alerts",
    lambda d: staged(
        op.rolling_ols(staged(d, z=op.zscore("volume", 26), y=F.ln("close")), "y", 12),
        breach=F.coalesce(F.abs("z") > 1.0, F.lit(False)).cast("int"),
        breaches=F.sum("breach").over(trailing(5)),
        shock=F.coalesce(F.abs("z") >= 2.0, F.lit(False)),
        flip=op.trend_flips(d, "slope"),
        jump=F.coalesce(F.abs(F.col("slope") - ref("slope", 3)) > 0.02, F.lit(False)),
    ),
    {"breaches": -1, "shock": -1, "flip": -1, "jump": -1},
    [
        f"(volume - ({q.ma('volume', 26)})) / nullif({q.std('volume', 26)}, 0) AS z, ln(close) AS y, CAST(pos AS DOUBLE) AS x",
        f"CASE WHEN abs(z) > 1.0 THEN 1 ELSE 0 END AS breach, CASE WHEN count(y) {q.w(12)} = 12 THEN regr_slope(y, x) {q.w(12)} END AS slope",
        f"CAST(sum(breach) {q.w(5)} AS BIGINT) AS breaches, coalesce(abs(z) >= 2.0, false) AS shock, coalesce(sign(slope) * sign({q.ref('slope')}) "
        f"< 0, false) AS flip, coalesce(abs(slope - {q.ref('slope', 3)}) > 0.02, false) AS jump",
    ],
)
_add(
    "win24_rolling_rmse",
    lambda d: staged(
        d,
        e=F.col("close") - ref("close"),
        e2=F.col("e") * F.col("e"),
        r10=F.sqrt(ma("e2", 10)),
        r20=F.sqrt(ma("e2", 20)),
        healthy=F.coalesce(F.col("r10") <= F.col("r20") * 1.2, F.lit(False))
    ),
    {"r10": 3, "r20": 3, "healthy": -1},
    [
        f"close - {q.ref('close')} AS e",
        f"sqrt({q.ma('e * e', 10)}) AS r10, sqrt({q.ma('e * e', 20)}) AS r20",
        "coalesce(r10 <= r20 * 1.2, false) AS healthy"
    ]
)
_add(
    "win25_return_grids",
    op.returns_grid,
    {"close_to_close": 4, "open_to_close": 4, "open_to_open": 4},
    [
        f"{q.change('close')} AS close_to_close, {q.div('close', 'open')} - 1 AS open_to_close, coalesce(open, close) AS o",
        f"{q.div(q.ref('o', -1), 'o')} - 1 AS open_to_open"
    ],
    by="nation"
)
_add("win26_forward_log_return", lambda d: staged(d, f=F.ln(ref("close", -4) / F.col("close"))), {"f": 5}, [f"ln({q.ref('close', -4)} / close) AS f"])



def _applied(d):
    d = staged(d, r=1 + change("close"), prev=ref("close"), age=F.least(F.lit(5.0), F.col("pos") + 1.0))
    d = op.rolling_apply(op.rolling_apply(d, "product", "r", 8, "p"), "rank", "volume", 10, "k")
    d = op.rolling_apply(op.rolling_apply(d, "rmse", ["close", "prev"], 10, "e"), "dot", ["close", "age"], 5, "s")
    return op.rolling_apply(d, lambda v: float(v.max() - v.min()), "volume", 6, "spread")


_add(
    "udf08_rolling_apply",
    _applied,
    {"p": 4, "k": 6, "e": 3, "s": 6, "spread": 2},
    [
        f"1 + {q.change('close')} AS r, {q.ref('close')} AS prev, least(5.0, pos + 1.0) AS age",
        f"{q.full('product', 'r', 8)} AS p, {q.ts_rank('volume', 10)} AS k, sqrt({q.ma('(close - prev) * (close - prev)', 10)}) AS e, "
        f"{q.full('sum', 'close * age', 5)} AS s, ({q.full('max', 'volume', 6)}) - ({q.full('min', 'volume', 6)}) AS spread",
    ],
)

# Indicators
_add(
    "ind01_multi_ma_bias",
    lambda d: staged(d, **{f"b{n}": F.col("close") / ma("close", n) - 1 for n in (5, 10, 20)}, bias=(F.col("b5") + F.col("b10") + F.col("b20")) / 3),
    {"bias": 5},
    [", ".join(f"close / ({q.ma('close', n)}) - 1 AS b{n}" for n in (5, 10, 20)), "(b5 + b10 + b20) / 3 AS bias"]
)
_add(
    "ind03_atr",
    lambda d: staged(
        d,
        prev=ref("close"),
        tr=F.when(
            F.col("prev").isNotNull() & F.col("high").isNotNull(),
            F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev")))
        ),
        atr=ma("tr", 14)
    ),
    {"atr": 3},
    [
        f"{q.ref('close')} AS prev",
        "CASE WHEN prev IS NOT NULL AND high IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr",
        f"{q.ma('tr', 14)} AS atr"
    ]
)
_add(
    "ind05_volume_ratio_score",
    lambda d: staged(
        d,
        vm=ma("volume", 20),
        vr=F.col("volume") / F.when(F.col("vm") > 0, F.col("vm")),
        score=F.least(F.greatest((F.col("vr") - 0.5) / 2, F.lit(0.0)), F.lit(1.0)),
        hold=full(F.min, "vr", 3)
    ),
    {"vr": 4, "hold": 4},
    [f"volume / nullif({q.ma('volume', 20)}, 0) AS vr", f"{q.full('min', 'vr', 3)} AS hold"]
)
_add(
    "ind07_log_return_vol",
    lambda d: staged(d, r=F.ln(F.col("close") / ref("close")), v=std("r", 20)),
    {"v": 5},
    [f"ln(close / {q.ref('close')}) AS r", f"{q.std('r', 20)} AS v"]
)
_add(
    "ind08_bias_panel",
    lambda d: staged(
        d,
        b=F.col("close") / ma("close", 50) - 1,
        mom=F.ln(ref("close", 4) / ref("close", 48)),
        f4=F.ln(ref("close", -4) / F.col("close"))
    ),
    {"b": 5, "mom": 5, "f4": 5},
    [f"close / ({q.ma('close', 50)}) - 1 AS b, ln({q.ref('close', 4)} / {q.ref('close', 48)}) AS mom, ln({q.ref('close', -4)} / close) AS f4"]
)
_add(
    "ind10_ratio_rebase",
    lambda d: staged(
        d,
        first=F.first("close", ignorenulls=True).over(trailing(None)),
        idx=F.col("close") / F.col("first") * 100,
        lr=F.ln(F.col("close") / F.col("first"))
    ),
    {"idx": 3, "lr": 5},
    [f"first_value(close IGNORE NULLS) {q.w()} AS f", "close / f * 100 AS idx, ln(close / f) AS lr"]
)
_add(
    "ind13_asset_scores",
    lambda d: staged(d, mom=change("close", 20), dist=F.col("close") / ma("close", 20) - 1),
    {"mom": 4, "dist": 4},
    [f"{q.change('close', 20)} AS mom, close / ({q.ma('close', 20)}) - 1 AS dist"]
)
