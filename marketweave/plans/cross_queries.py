"""Registered cross-section, ranking and metric queries over the research panel."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import div, pooled_quantiles, ref, staged
from ..operators import cross_section as xs
from ..operators import metrics as m
from ..operators.windows import rebalance_every
from ..sources.panel import panel
from . import sqlkit as q

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FREQ = 26.0


def _add(key: str, build, digits: dict[str, int], sql: str | None, plain: tuple[str, ...] = ()) -> None:
    """Registers build(panel); digits are the rounded columns, plain those taken as they are, in both engines."""

    def run(spark, sf_dir):
        return build(panel(spark, sf_dir)).select(*plain, *[F.round(c, d).alias(c) for c, d in digits.items()])

    QUERIES[key] = run
    if sql is not None:
        chosen = ", ".join([*plain, *[f"round({c}, {d}) + 0.0 AS {c}" for c, d in digits.items()]])
        ORACLE_SQL[key] = f"WITH {q.PANEL},\n{sql.strip()}\nSELECT {chosen} FROM final"


_DT = ("date", "ticker")
_QS = "quantile_cont({x}, {p}) OVER (PARTITION BY date)"
_PD = "OVER (PARTITION BY date)"

_add("xs01_winsorized_zscore", lambda d: xs.winsorized_zscore(d.where("score is not null"), "score", 0.05, 0.95), {"z": 5}, f"""
w AS (SELECT *, count(score) {_PD} AS n, {_QS.format(x='score', p=0.05)} AS lo, {_QS.format(x='score', p=0.95)} AS hi FROM panel WHERE score IS NOT NULL),
c AS (SELECT *, least(greatest(score, lo), hi) AS c FROM w), s AS (SELECT *, avg(c) {_PD} AS mu, stddev_samp(c) {_PD} AS sd FROM c),
final AS (SELECT date, ticker, CASE WHEN n < 5 THEN score WHEN sd > 1e-12 THEN (c - mu) / sd ELSE c END AS z FROM s)""", _DT)
_add("xs02_panel_zscore", lambda d: d.where("score is not null").withColumn("z", div(F.col("score") - F.avg("score").over(xs.by_date()), F.stddev_samp("score").over(xs.by_date()))), {"z": 5}, f"""
final AS (SELECT date, ticker, (score - avg(score) {_PD}) / stddev_samp(score) {_PD} AS z FROM panel WHERE score IS NOT NULL)""", _DT)
_add(
    "xs03_sector_demean",
    lambda d: xs.demean(d.where("score is not null"), "score", "sector"),
    {"d": 5},
    "final AS (SELECT date, ticker, score - avg(score) OVER (PARTITION BY date, sector) AS d FROM panel WHERE score IS NOT NULL)",
    _DT
)
_add("xs04_neutralize", lambda d: xs.neutralize(d.where("score is not null"), "score", "sector", "mcap", 0.05, 0.95), {"resid": 5}, f"""
b AS (SELECT *, ln(mcap) AS l FROM panel WHERE score IS NOT NULL), c AS (SELECT *, least(greatest(l, {_QS.format(x='l', p=0.05)}), {_QS.format(x='l', p=0.95)}) AS lc FROM b),
e AS (SELECT *, score - avg(score) OVER (PARTITION BY date, sector) AS dx, lc - avg(lc) OVER (PARTITION BY date, sector) AS dl FROM c),
f AS (SELECT *, sum(dl * dl) {_PD} AS sq, sum(dx * dl) {_PD} AS sxy FROM e),
final AS (SELECT date, ticker, dx - CASE WHEN sq > 1e-12 THEN sxy / sq ELSE 0 END * dl AS resid FROM f)""", _DT)
_B5 = q.bucket("score", 5)
_BUCKETED = f"b0 AS (SELECT *, {_B5[0]} FROM panel), b AS (SELECT *, {_B5[1]} FROM b0)"
_add(
    "xs05_buckets",
    lambda d: xs.buckets(d, "score", 5).where("bucket is not null"),
    {},
    f"{_BUCKETED}, final AS (SELECT * FROM b WHERE bucket IS NOT NULL)",
    (*_DT, "bucket")
)
_add("xs06_qcut_buckets", lambda d: xs.buckets(d, "score", 5, "qcut").where("bucket is not null"), {}, f"""{_BUCKETED},
final AS (SELECT date, ticker, greatest(1, (bi * 5 + bm - 2) // (bm - 1)) AS bucket FROM b WHERE bucket IS NOT NULL)""", (*_DT, "bucket"))
_add("xs07_rank_floor_spread", lambda d: xs.double_tail_spread(xs.buckets(d, "score", 5, "rank_floor"), "bucket", "fwd", 5), {"spread": 5}, f"""
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) - 1 AS i, count(*) {_PD} AS n FROM panel WHERE score IS NOT NULL),
k AS (SELECT *, least(5, (i * 5) // n + 1) AS bucket FROM r WHERE n >= 5),
final AS (SELECT date, avg(CASE WHEN bucket IN (1, 5) THEN fwd END) - avg(CASE WHEN bucket NOT IN (1, 5) THEN fwd END) AS spread FROM k WHERE fwd IS NOT NULL GROUP BY date)""", ("date",))
_add("xs08_grades", lambda d: xs.grades(d.where("fwd is not null"), "fwd", 5, 10), {}, f"""
r AS (SELECT date, ticker, {q.cs_rank('fwd')} * count(fwd) {_PD} AS k, count(fwd) {_PD} AS n FROM panel WHERE fwd IS NOT NULL),
final AS (SELECT date, ticker, CAST(CASE WHEN n >= 10 THEN least(4, floor((k - 1) / greatest(n / 5.0, 1))) END AS INTEGER) AS grade FROM r)""", (*_DT, "grade"))
_LONG = (
    "SELECT date, ticker, 'score' AS feature, score AS value, fwd FROM panel UNION ALL SELECT date, ticker, 'size', ln(mcap), fwd FROM panel "
    "UNION ALL SELECT date, ticker, 'volume', volume, fwd FROM panel"
)


def _long(d):
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("feature"), x.alias("value")) for n,
                x in (("score", F.col("score")), ("size", F.ln("mcap")), ("volume", F.col("volume")))
            ]
        )
    )
    return d.select("date", "ticker", "fwd", each.alias("e")).select("date", "ticker", "e.feature", "e.value", "fwd")


_add("xs09_feature_signs", lambda d: xs.flip_signs(_long(d), "fwd"), {}, f"""
l AS ({_LONG}), v AS (SELECT * FROM l WHERE value IS NOT NULL AND fwd IS NOT NULL),
k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, fwd) - 1) / 2.0 AS b FROM v),
final AS (SELECT feature, CASE WHEN covar_samp(a, b) < 0 THEN -1 ELSE 1 END AS sign FROM k GROUP BY feature)""", ("feature", "sign"))
_add(
    "xs10_long_panel",
    lambda d: _long(d).where("value is not null and fwd is not null"),
    {"value": 6, "fwd": 6},
    f"l AS ({_LONG}), final AS (SELECT * FROM l WHERE value IS NOT NULL AND fwd IS NOT NULL)",
    (*_DT, "feature")
)
_add(
    "xs11_bucket_history",
    lambda d: xs.buckets(d, "score", 5).where("ticker = 'Brand#7' and bucket is not null"),
    {},
    f"{_BUCKETED}, final AS (SELECT * FROM b WHERE ticker = 'Brand#7' AND bucket IS NOT NULL)",
    ("date", "bucket")
)

# Rebalance every HOLD rows; bucket series as strategies
_GRID = (
    f"{_BUCKETED}, g AS (SELECT * FROM b WHERE pos % 2 = 0), br AS (SELECT date, bucket, avg(fwd) AS ret, count(*) AS n FROM g "
    f"WHERE bucket IS NOT NULL AND fwd IS NOT NULL GROUP BY date, bucket)"
)
_grid = lambda d: rebalance_every(xs.buckets(d, "score", 5), 2)
_returns = lambda d: m.bucket_returns(_grid(d), "bucket", "fwd")
_LS = f"{_GRID}, ls AS (SELECT date, max(CASE WHEN bucket = 5 THEN ret END) - max(CASE WHEN bucket = 1 THEN ret END) AS ret FROM br GROUP BY date)"
_PERF = (
    "pow(product(1 + ret), {f} / count(ret)) - 1 AS ann_return, stddev_pop(ret) * sqrt({f}) AS ann_vol, avg(ret) / nullif(stddev_pop(ret), 0) * "
    "sqrt({f}) AS sharpe".format(f=FREQ)
)
_DDS = (
    "e AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq "
    "FROM src), f AS (SELECT *, eq / max(eq) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)"
)


def _ticker(d):
    return d.where("ret is not null").withColumn("ret", F.col("ret") / 10)


_TICKER = "src AS (SELECT date, ticker AS k, ticker, ret / 10 AS ret FROM panel WHERE ret IS NOT NULL)"
_add(
    "agg01_annual_return",
    lambda d: _ticker(d).groupBy("ticker").agg(m.annual_return("ret", 52).alias("v")),
    {"v": 5},
    f"{_TICKER}, final AS (SELECT ticker, pow(product(1 + ret), 52.0 / count(ret)) - 1 AS v FROM src GROUP BY ticker)",
    ("ticker",)
)
_add(
    "agg02_annual_vol",
    lambda d: _ticker(d).groupBy("ticker").agg(m.annual_vol("ret", 52).alias("v"), m.annual_vol("ret", 52, 1).alias("v1")),
    {"v": 5, "v1": 5},
    f"{_TICKER}, final AS (SELECT ticker, stddev_pop(ret) * sqrt(52) AS v, stddev_samp(ret) * sqrt(52) AS v1 FROM src GROUP BY ticker)",
    ("ticker",)
)
_add(
    "agg03_sharpe",
    lambda d: _ticker(d).groupBy("ticker").agg(m.sharpe("ret", 52, 0.02).alias("v")),
    {"v": 5},
    f"{_TICKER}, final AS (SELECT ticker, (avg(ret) - (pow(1.02, 1 / 52.0) - 1)) * 52 / (stddev_pop(ret) * sqrt(52)) AS v FROM src GROUP BY ticker)",
    ("ticker",)
)
_add(
    "agg04_max_drawdown",
    lambda d: m.with_drawdown(_ticker(d), "ret", "ticker").groupBy("ticker").agg(F.min("dd").alias("mdd")),
    {"mdd": 6},
    f"{_TICKER}, {_DDS}, final AS (SELECT ticker, min(dd) AS mdd FROM f GROUP BY ticker)",
    ("ticker",)
)
_add(
    "agg05_mom_decile_summary",
    lambda d: m.perf_summary(_returns(d).withColumn("ret", F.col("ret") / 10), "ret", "bucket", FREQ),
    {"ann_return": 4, "ann_vol": 5, "sharpe": 4, "max_drawdown": 5},
    f"{_GRID}, src AS (SELECT date, bucket AS k, bucket, ret / 10 AS ret FROM br), {_DDS}, final AS (SELECT bucket, {_PERF}, min(dd) AS "
    f"max_drawdown, count(ret) AS n FROM f GROUP BY bucket)",
    ("bucket", "n")
)
_add(
    "agg06_yearly_returns",
    lambda d: _ticker(d).groupBy("ticker", F.year("date").alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("v")),
    {"v": 5},
    f"{_TICKER}, final AS (SELECT ticker, year(date) AS year, product(1 + ret) - 1 AS v FROM src GROUP BY ticker, year(date))",
    ("ticker", "year")
)
_IC = (
    f"j AS (SELECT * FROM panel WHERE score IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT *, {q.cs_rank('score')} AS a, {q.cs_rank('fwd')} AS c "
    f"FROM j), ic AS (SELECT date, CASE WHEN count(*) >= 5 THEN covar_samp(a, c) / nullif(stddev_samp(a) * stddev_samp(c), 0) END AS ic, count(*) "
    f"AS n, covar_samp(score, fwd) / nullif(stddev_samp(score) * stddev_samp(fwd), 0) AS pearson FROM k GROUP BY date)"
)
# the hit rate asks for the sign of ic: from whole numbers, an ic of 0 is 0 in any order of rows
_CENTRED = "2 * rank() OVER (PARTITION BY date ORDER BY {x}) + count(*) OVER (PARTITION BY date, {x}) - count(*) OVER (PARTITION BY date) - 2"
_IC_EXACT = (
    f"j AS (SELECT * FROM panel WHERE score IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT *, {_CENTRED.format(x='score')} AS a, "
    f"{_CENTRED.format(x='fwd')} AS c FROM j), ic AS (SELECT date, CASE WHEN count(*) >= 5 THEN CAST(sum(a * c) AS DOUBLE) / "
    f"nullif(sqrt(CAST(sum(a * a) AS DOUBLE) * CAST(sum(c * c) AS DOUBLE)), 0) END AS ic FROM k GROUP BY date)"
)
_ic = lambda d: m.spearman_ic(d, "score", "fwd", 5)
_add(
    "agg07_icir",
    lambda d: _ic(d).groupBy(F.year("date").alias("year")).agg(m.icir("ic").alias("v")),
    {"v": 5},
    f"{_IC}, final AS (SELECT year(date) AS year, CASE WHEN count(ic) >= 2 THEN avg(ic) / nullif(stddev_pop(ic), 0) END AS v FROM ic "
    f"GROUP BY year(date))",
    ("year",)
)
_add(
    "agg08_ic_stats",
    lambda d: m.ic_stats(_ic(d).withColumn("year", F.year("date")), ["year"]),
    {"mean": 5, "std": 5, "icir": 5, "hit": 5},
    f"{_IC_EXACT}, final AS (SELECT year(date) AS year, avg(ic) AS mean, stddev_pop(ic) AS std, avg(ic) / nullif(stddev_pop(ic), 0) AS icir, avg(CASE "
    f"WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit, count(ic) AS n FROM ic GROUP BY year(date))",
    ("year", "n")
)
_add("agg09_spearman_ic", _ic, {"ic": 6}, f"{_IC}, final AS (SELECT * FROM ic)", ("date", "n"))
_add(
    "agg10_ic_both",
    lambda d: m.spearman_ic(d, "score", "fwd", 5).join(
        d.where("score is not null and fwd is not null").groupBy("date").agg(m.corr_of("score", "fwd").alias("pearson")),
        "date"
    ),
    {"ic": 6, "pearson": 6},
    f"{_IC}, final AS (SELECT * FROM ic)",
    ("date", "n")
)
_add(
    "agg11_coverage",
    lambda d: rebalance_every(d, 2).groupBy("date").agg(
        (F.count(F.when(F.col("score").isNotNull() & F.col("fwd").isNotNull(), 1)) / F.count("*")).alias("coverage"),
        F.count("score").alias("n_score")
    ),
    {"coverage": 6},
    "final AS (SELECT date, count(CASE WHEN score IS NOT NULL AND fwd IS NOT NULL THEN 1 END) / count(*) AS coverage, count(score) AS n_score "
    "FROM panel WHERE pos % 2 = 0 GROUP BY date)",
    ("date", "n_score")
)
_add("agg12_bucket_returns", _returns, {"ret": 5}, f"{_GRID}, final AS (SELECT * FROM br)", ("date", "bucket", "n"))
_add(
    "agg13_bucket_summary",
    lambda d: m.bucket_summary(_returns(d), "bucket"),
    {"mean": 5, "std": 5, "t_stat": 4},
    f"{_GRID}, final AS (SELECT bucket, avg(ret) AS mean, stddev_pop(ret) AS std, count(ret) AS n, avg(ret) / nullif(stddev_pop(ret), 0) * "
    f"sqrt(count(ret)) AS t_stat FROM br GROUP BY bucket)",
    ("bucket", "n")
)
_add(
    "agg14_monotonicity",
    lambda d: m.monotonicity(m.bucket_summary(_returns(d), "bucket"), "bucket"),
    {"monotonicity": 6},
    f"{_GRID}, sm AS (SELECT 1 AS date, bucket, avg(ret) AS mean FROM br GROUP BY bucket), k AS (SELECT {q.cs_rank('bucket')} AS a, "
    f"{q.cs_rank('mean')} AS c FROM sm), final AS (SELECT covar_samp(a, c) / nullif(stddev_samp(a) * stddev_samp(c), 0) AS monotonicity FROM k)"
)
_add("agg15_long_short", lambda d: m.long_short(_returns(d), "bucket", 5, 1), {"ret": 5}, f"{_LS}, final AS (SELECT * FROM ls)", ("date",))
_add(
    "agg16_turnover_proxy",
    lambda d: m.turnover_proxy(_grid(d), "bucket", 5),
    {"turnover": 6},
    f"{_GRID}, t AS (SELECT date, CASE WHEN bucket = 5 THEN 1 ELSE 0 END AS i, CASE WHEN lag(bucket) OVER ({q.TS}) = 5 THEN 1 ELSE 0 END AS w "
    f"FROM g), final AS (SELECT date, 1 - sum(i * w) / sum(i) AS turnover FROM t GROUP BY date HAVING sum(i) > 0)",
    ("date",)
)


def _ics(d):
    return m.spearman_ic(_long(d), "value", "fwd", 5, ["date", "feature"])


_ICS = (
    f"l AS ({_LONG}), v AS (SELECT * FROM l WHERE value IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT *, {q.cs_rank('value', 'date, feature')} AS "
    f"a, {q.cs_rank('fwd', 'date, feature')} AS c FROM v), ics AS (SELECT date, feature, "
    f"CASE WHEN count(*) >= 5 THEN covar_samp(a, c) / nullif(stddev_samp(a) * stddev_samp(c), 0) END AS ic FROM k GROUP BY date, feature)"
)
_IC_PAIRS = (
    f"{_ICS}, p AS (SELECT x.feature AS a, y.feature AS b, x.ic AS x, y.ic AS y FROM ics x JOIN ics y ON x.date = y.date AND x.feature < y.feature "
    f"WHERE x.ic IS NOT NULL AND y.ic IS NOT NULL), final AS (SELECT a, b, count(*) AS n, "
    f"CASE WHEN count(*) >= 60 THEN covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) END AS corr FROM p GROUP BY a, b)"
)
_add("agg19_ic_correlation", lambda d: m.pairwise_corr(_ics(d), "feature", "ic", "date", 60), {"corr": 5}, _IC_PAIRS, ("a", "b", "n"))
_add(
    "jon19_ic_pairs",
    lambda d: m.pairwise_corr(_ics(d), "feature", "ic", "date", 200),
    {"corr": 5},
    _IC_PAIRS.replace(">= 60", ">= 200"),
    ("a", "b", "n")
)
_add(
    "agg38_signal_sweep",
    lambda d: m.ic_stats(_ics(d), ["feature"]),
    {"mean": 5, "std": 5, "icir": 5, "hit": 5},
    f"{_ICS}, final AS (SELECT feature, avg(ic) AS mean, stddev_pop(ic) AS std, avg(ic) / nullif(stddev_pop(ic), 0) AS icir, avg(CASE WHEN ic > 0 "
    f"THEN 1.0 ELSE 0.0 END) AS hit, count(ic) AS n FROM ics GROUP BY feature)",
    ("feature", "n")
)
_add(
    "agg45_ic_frame",
    lambda d: _ics(d).groupBy("date").pivot("feature", ["score", "size", "volume"]).agg(F.max("ic")),
    {"score": 5, "size": 5, "volume": 5},
    f"{_ICS}, final AS (SELECT date, max(CASE WHEN feature = 'score' THEN ic END) AS score, max(CASE WHEN feature = 'size' THEN ic END) AS size, "
    f"max(CASE WHEN feature = 'volume' THEN ic END) AS volume FROM ics GROUP BY date)",
    ("date",)
)
_add(
    "win13_rolling_ic",
    lambda d: _ic(d).withColumn("k", F.lit(1)).withColumn(
        "avg_ic",
        F.when(
            F.count("ic").over(Window.partitionBy("k").orderBy("date").rowsBetween(-9, 0)) == 10,
            F.avg("ic").over(Window.partitionBy("k").orderBy("date").rowsBetween(-9, 0))
        )
    ),
    {"avg_ic": 6},
    f"{_IC}, final AS (SELECT date, CASE WHEN count(ic) OVER (ORDER BY date ROWS 9 PRECEDING) = 10 THEN avg(ic) OVER (ORDER BY date ROWS 9 "
    f"PRECEDING) END AS avg_ic FROM ic)",
    ("date",)
)
_add(
    "agg35_return_correlation",
    lambda d: m.pairwise_corr(d, "ticker", "ret", "date", 10),
    {"corr": 5},
    "r AS (SELECT * FROM panel WHERE ret IS NOT NULL), final AS (SELECT x.ticker AS a, y.ticker AS b, "
    "CASE WHEN count(*) >= 10 THEN covar_samp(x.ret, y.ret) / (stddev_samp(x.ret) * stddev_samp(y.ret)) END AS corr, count(*) AS n FROM r x "
    "JOIN r y ON x.date = y.date AND x.ticker < y.ticker GROUP BY x.ticker, y.ticker)",
    ("a", "b", "n")
)
_add(
    "agg36_bucket_membership",
    lambda d: _grid(d).where("bucket is not null").groupBy("ticker").agg(
        F.avg((F.col("bucket") == 5).cast("double")).alias("freq"),
        F.avg(F.when(F.col("bucket") == 5, F.col("fwd"))).alias("ret_in"),
        F.count("*").alias("n")
    ),
    {"freq": 6, "ret_in": 5},
    f"{_GRID}, final AS (SELECT ticker, avg(CASE WHEN bucket = 5 THEN 1.0 ELSE 0.0 END) AS freq, avg(CASE WHEN bucket = 5 THEN fwd END) AS ret_in, "
    f"count(*) AS n FROM g WHERE bucket IS NOT NULL GROUP BY ticker)",
    ("ticker", "n")
)
_add(
    "agg41_drawdown_duration",
    lambda d: m.drawdown_duration(_ticker(d), "ret", "ticker"),
    {},
    f"{_TICKER}, {_DDS}, h AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING) AS p "
    f"FROM f), r AS (SELECT ticker, p, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) AS run FROM h "
    f"GROUP BY ticker, p), final AS (SELECT ticker, CAST(max(run) AS BIGINT) AS longest FROM r GROUP BY ticker)",
    ("ticker", "longest")
)
_add(
    "agg42_sortino",
    lambda d: _ticker(d).groupBy("ticker").agg(m.sortino("ret", 52).alias("v")),
    {"v": 5},
    f"{_TICKER}, final AS (SELECT ticker, avg(ret) * sqrt(52) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) AS v FROM src GROUP BY ticker)",
    ("ticker",)
)
_add(
    "agg47_seasonality",
    lambda d: _ticker(d).groupBy(F.month("date").alias("month")).agg(
        F.count("*").alias("n"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("std"),
        F.min("ret").alias("low"),
        F.percentile("ret", F.lit(0.5)).alias("median"),
        F.max("ret").alias("high")
    ),
    {"mean": 5, "std": 5, "low": 5, "median": 5, "high": 5},
    f"{_TICKER}, final AS (SELECT month(date) AS month, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, min(ret) AS low, "
    f"quantile_cont(ret, 0.5) AS median, max(ret) AS high FROM src GROUP BY month(date))",
    ("month", "n")
)
_binned = lambda d: xs.buckets(d, "score", 5).where("bucket is not null and fwd is not null")
_add(
    "agg48_quantile_bins",
    lambda d: _binned(d).groupBy("bucket").agg(
        F.avg("fwd").alias("mean"),
        F.max("fwd").alias("high"),
        F.min("fwd").alias("low"),
        F.stddev_samp("fwd").alias("std"),
        F.count("*").alias("n")
    ).join(pooled_quantiles(_binned(d), ["bucket"], "fwd", {"median": 0.5}), "bucket"),
    {"mean": 5, "median": 5, "high": 5, "low": 5, "std": 5},
    f"{_BUCKETED}, final AS (SELECT bucket, avg(fwd) AS mean, quantile_cont(fwd, 0.5) AS median, max(fwd) AS high, min(fwd) AS low, "
    f"stddev_samp(fwd) AS std, count(*) AS n FROM b WHERE bucket IS NOT NULL AND fwd IS NOT NULL GROUP BY bucket)",
    ("bucket", "n")
)
_PS = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
_add(
    "agg49_percentile_table",
    lambda d: d.groupBy("ticker").agg(
        F.percentile("px", F.array(*map(F.lit, _PS))).alias("v"),
        F.avg("px").alias("mean")
    ).select("ticker", "mean", F.posexplode("v").alias("place", "v")),
    {"v": 4, "mean": 4},
    f"p AS (SELECT ticker, quantile_cont(px, [{', '.join(map(str, _PS))}]) AS vs, avg(px) AS mean FROM panel "
    f"GROUP BY ticker), final AS (SELECT ticker, mean, CAST(i - 1 AS INTEGER) AS place, vs[i] AS v FROM p, range(1, {len(_PS) + 1}) r(i))",
    ("ticker", "place")
)
_add(
    "agg50_arithmetic_stats",
    lambda d: _ticker(d).groupBy("ticker").agg(
        (F.avg("ret") * 52).alias("mean"),
        m.annual_vol("ret", 52, 1).alias("vol"),
        (m.annual_return("ret", 52) / m.annual_vol("ret", 52)).alias("geo_sharpe")
    ),
    {"mean": 5, "vol": 5, "geo_sharpe": 4},
    f"{_TICKER}, final AS (SELECT ticker, avg(ret) * 52 AS mean, stddev_samp(ret) * sqrt(52) AS vol, (pow(product(1 + ret), 52.0 / count(ret)) - 1) "
    f"/ (stddev_pop(ret) * sqrt(52)) AS geo_sharpe FROM src GROUP BY ticker)",
    ("ticker",)
)


def _horizons(d):
    d = staged(xs.buckets(d, "score", 5), **{f"f{h}": ref("px", -(h + 1)) / ref("px", -1) - 1 for h in (1, 2, 4, 8)})
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("r")) for h in (1, 2, 4, 8)]))
    rows = d.select("pos", "bucket", each.alias("e")).where("bucket is not null and e.r is not null and pos % (e.horizon + 1) = 0")
    return rows.groupBy("e.horizon", "bucket").agg(F.avg("e.r").alias("mean"), F.count("*").alias("n"))


_add(
    "agg51_horizon_scan",
    _horizons,
    {"mean": 5},
    f"{_BUCKETED}, h AS (" + " UNION ALL ".join(
        f"SELECT pos, bucket, {h} AS horizon, {q.ref('px', -(h + 1))} / {q.ref('px', -1)} - 1 AS r FROM b" for h in (1, 2, 4, 8)
    ) + "), final AS (SELECT horizon, bucket, avg(r) AS mean, count(*) AS n FROM h WHERE bucket IS NOT NULL AND r IS NOT NULL AND pos % (horizon + 1) = "
    "0 GROUP BY horizon, bucket)",
    ("horizon", "bucket", "n")
)

# Classification: does a high score foretell a gain?
_CLS = (
    f"c AS (SELECT year(date) AS year, {q.cs_rank('score')} AS p, CASE WHEN fwd > 0 THEN 1 ELSE 0 END AS y FROM panel "
    f"WHERE score IS NOT NULL AND fwd IS NOT NULL)"
)


def _classes(d):
    rows = d.where("score is not null and fwd is not null")
    return rows.select(F.year("date").alias("year"), xs.cs_rank("score").alias("p"), (F.col("fwd") > 0).cast("int").alias("y"))


_add(
    "agg23_rates_by_period",
    lambda d: _classes(d).groupBy((F.floor(F.col("year") / 2) * 2).alias("period")).agg(
        *[
            F.avg(F.when(c, 1.0).otherwise(0.0)).alias(n) for n,
            c in (
                ("tp", (F.col("p") >= 0.5) & (F.col("y") == 1)),
                ("fp", (F.col("p") >= 0.5) & (F.col("y") == 0)),
                ("fn", (F.col("p") < 0.5) & (F.col("y") == 1))
            )
        ]
    ),
    {"tp": 6, "fp": 6, "fn": 6},
    f"{_CLS}, final AS (SELECT CAST(year // 2 * 2 AS BIGINT) AS period, avg(CASE WHEN p >= 0.5 AND y = 1 THEN 1.0 ELSE 0.0 END) AS tp, avg(CASE "
    f"WHEN p >= 0.5 AND y = 0 THEN 1.0 ELSE 0.0 END) AS fp, avg(CASE WHEN p < 0.5 AND y = 1 THEN 1.0 ELSE 0.0 END) AS fn FROM c GROUP BY year // 2)",
    ("period",)
)
_add(
    "agg24_confusion",
    lambda d: m.confusion(_classes(d), "p", "y", 0.6, ["year"]),
    {"precision": 6, "recall": 6},
    f"{_CLS}, t AS (SELECT year, count(CASE WHEN p >= 0.6 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p >= 0.6 AND y = 0 THEN 1 END) AS fp, "
    f"count(CASE WHEN p < 0.6 AND y = 0 THEN 1 END) AS tn, count(CASE WHEN p < 0.6 AND y = 1 THEN 1 END) AS fn FROM c "
    f"GROUP BY year), final AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM t)",
    ("year", "tp", "fp", "tn", "fn")
)
_ROC = (
    f"{_CLS}, g AS (SELECT year, p AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM c "
    f"GROUP BY year, p), s AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY year) AS ap, sum(neg) OVER "
    f"(PARTITION BY year) AS an FROM g WINDOW w AS (PARTITION BY year ORDER BY threshold DESC)), r AS (SELECT *, tp / ap AS tpr, fp / an AS fpr, tp "
    f"/ (tp + fp) AS precision FROM s), l AS (SELECT *, coalesce(lag(tpr) OVER w, 0) AS t0, coalesce(lag(fpr) OVER w, 0) AS f0 "
    f"FROM r WINDOW w AS (PARTITION BY year ORDER BY threshold DESC))"
)
_add(
    "agg25_roc_auc",
    lambda d: m.auc(_classes(d), "p", "y", "year"),
    {"auc": 6, "average_precision": 6},
    f"{_ROC}, final AS (SELECT year, sum((fpr - f0) * (tpr + t0) / 2) AS auc, sum((tpr - t0) * precision) AS average_precision FROM l GROUP BY year)",
    ("year",)
)
_add(
    "agg26_brier_calibration",
    lambda d: m.calibration(_classes(d), "p", "y"),
    {"mean_p": 6, "rate": 6},
    f"{_CLS}, final AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, avg(p) AS mean_p, avg(y) AS rate, count(*) AS n FROM c GROUP BY 1)",
    ("bin", "n")
)
_add(
    "agg27_event_study",
    lambda d: m.event_study(
        staged(d, f1=ref("px", -1) / F.col("px") - 1, f4=ref("px", -4) / F.col("px") - 1),
        F.col("ret") < -0.4,
        {"h1": "f1", "h4": "f4"}
    ),
    {"mean": 5, "hit": 5, "p10": 5, "p50": 5, "p90": 5},
    f"e AS (SELECT *, {q.ref('px', -1)} / px - 1 AS f1, {q.ref('px', -4)} / px - 1 AS f4 FROM panel), h AS (SELECT 'h1' AS horizon, f1 AS r FROM e "
    f"WHERE ret < -0.4 UNION ALL SELECT 'h4', f4 FROM e WHERE ret < -0.4), final AS (SELECT horizon, count(*) AS n, avg(r) AS mean, avg(CASE WHEN r "
    f"> 0 THEN 1.0 ELSE 0.0 END) AS hit, quantile_cont(r, 0.1) AS p10, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.9) AS p90 FROM h "
    f"WHERE r IS NOT NULL GROUP BY horizon)",
    ("horizon", "n")
)
_add(
    "agg28_event_skew",
    lambda d: d.where("ret < -0.3 and fwd is not null").groupBy("sector").agg(
        F.count("*").alias("n"),
        F.percentile("fwd", F.lit(0.5)).alias("median"),
        F.stddev_samp("fwd").alias("std"),
        m.sample_skew("fwd").alias("skew")
    ),
    {"median": 5, "std": 5, "skew": 4},
    "final AS (SELECT sector, count(*) AS n, quantile_cont(fwd, 0.5) AS median, stddev_samp(fwd) AS std, skewness(fwd) AS skew FROM panel "
    "WHERE ret < -0.3 AND fwd IS NOT NULL GROUP BY sector)",
    ("sector", "n")
)
_add(
    "agg34_enrichment",
    lambda d: m.enrichment(d.where("score is not null and fwd is not null"), F.col("score") < -0.4, F.col("fwd") > 0.1),
    {"odds_ratio": 6, "p": 6},
    "t AS (SELECT score < -0.4 AS s, fwd > 0.1 AS y FROM panel WHERE score IS NOT NULL AND fwd IS NOT NULL), n AS (SELECT count(CASE WHEN s AND y "
    "THEN 1 END) AS a, count(CASE WHEN s AND NOT y THEN 1 END) AS b, count(CASE WHEN NOT s AND y THEN 1 END) AS c, count(CASE WHEN NOT s AND NOT y "
    "THEN 1 END) AS d FROM t), lc AS (SELECT *, a + b + c + d AS nn, a + b AS rw, a + c AS cl "
    "FROM n), final AS (SELECT *, CAST(a * d AS DOUBLE) / nullif(b * c, 0) AS odds_ratio, least(1.0, list_sum([exp(lgamma(rw + 1.0) - lgamma(k + "
    "1.0) - lgamma(rw - k + 1.0) + lgamma(nn - rw + 1.0) - lgamma(cl - k + 1.0) - lgamma(nn - rw - cl + k + 1.0) - lgamma(nn + 1.0) + lgamma(cl + "
    "1.0) + lgamma(nn - cl + 1.0)) for k in generate_series(greatest(a, rw + cl - nn), least(rw, cl))])) AS p FROM lc)",
    ("a", "b", "c", "d")
)
# States
_STATE = "st AS (SELECT *, CASE WHEN ret > 0.2 THEN 'up' WHEN ret < -0.2 THEN 'down' WHEN ret IS NOT NULL THEN 'flat' END AS state FROM panel)"
_state = lambda d: d.withColumn("state", F.when(F.col("ret") > 0.2, "up").when(F.col("ret") < -0.2, "down").when(F.col("ret").isNotNull(), "flat"))
_add(
    "agg20_regime_frequency",
    lambda d: _state(d).where("state is not null").groupBy("ticker", "state").agg(F.count("*").alias("n")).withColumn(
        "share",
        xs.share_of("n", ["ticker"])
    ),
    {"share": 6},
    f"{_STATE}, c AS (SELECT ticker, state, count(*) AS n FROM st WHERE state IS NOT NULL "
    f"GROUP BY ticker, state), final AS (SELECT *, n / sum(n) OVER (PARTITION BY ticker) AS share FROM c)",
    ("ticker", "state")
)
_add(
    "agg21_transition_matrix",
    lambda d: m.transition_matrix(_state(d), "state", "ticker"),
    {"share": 6},
    f"{_STATE}, t AS (SELECT lag(state) OVER ({q.TS}) AS prev, state FROM st), c AS (SELECT prev, state, count(*) AS n FROM t "
    f"WHERE prev IS NOT NULL AND state IS NOT NULL GROUP BY prev, state), final AS (SELECT prev, state, n / sum(n) OVER (PARTITION BY prev) AS "
    f"share FROM c)",
    ("prev", "state")
)
_add(
    "agg22_stats_by_regime",
    lambda d: _state(d).where("state is not null and fwd is not null").groupBy("state").agg(
        F.count("*").alias("n"),
        F.avg("fwd").alias("mean"),
        m.annual_vol("fwd", 26).alias("vol"),
        m.sortino("fwd", 26).alias("sortino"),
        F.avg((F.col("fwd") > 0).cast("double")).alias("hit")
    ),
    {"mean": 5, "vol": 5, "sortino": 4, "hit": 5},
    f"{_STATE}, final AS (SELECT state, count(*) AS n, avg(fwd) AS mean, stddev_pop(fwd) * sqrt(26) AS vol, avg(fwd) * sqrt(26) / "
    f"sqrt(avg(pow(least(fwd, 0), 2))) AS sortino, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM st "
    f"WHERE state IS NOT NULL AND fwd IS NOT NULL GROUP BY state)",
    ("state", "n")
)

# Top-k
_TOP = (
    "tk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS place FROM panel "
    "WHERE score IS NOT NULL AND pos % 2 = 0), bk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS place FROM panel "
    "WHERE score IS NOT NULL AND pos % 2 = 0)"
)
_add(
    "top01_long_short_weights",
    lambda d: xs.top_k(d.where("pos % 2 = 0"), "score", 3).withColumn("w", F.lit(1 / 3)).unionByName(
        xs.bottom_k(d.where("pos % 2 = 0"), "score", 3).withColumn("w", F.lit(-1 / 3))
    ),
    {"w": 6},
    f"{_TOP}, final AS (SELECT date, ticker, 1 / 3.0 AS w FROM tk WHERE place <= 3 UNION ALL SELECT date, ticker, -1 / 3.0 FROM bk WHERE place <= 3)",
    _DT
)
_add(
    "top02_top_n_equal",
    lambda d: xs.top_k(d.where("pos % 2 = 0"), "score", 5).withColumn("w", 1 / F.count("*").over(xs.by_date())),
    {"w": 6},
    f"{_TOP}, final AS (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM tk WHERE place <= 5)",
    _DT
)
_add(
    "top03_top_n_eligible",
    lambda d: xs.top_k(
        d.where("pos % 2 = 0 and volume > 100"),
        "score",
        5
    ).where("fwd is not null").groupBy("date").agg(F.avg("fwd").alias("ret"), F.count("*").alias("n")),
    {"ret": 5},
    "tk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS place FROM panel "
    "WHERE score IS NOT NULL AND pos % 2 = 0 AND volume > 100), final AS (SELECT date, avg(fwd) AS ret, count(*) AS n FROM tk "
    "WHERE place <= 5 AND fwd IS NOT NULL GROUP BY date)",
    ("date", "n")
)
_add(
    "top04_top_k_inverse_vol",
    lambda d: xs.top_k(
        staged(d, vol=F.stddev_samp("ret").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(-11, 0))).where("pos % 4 = 0 and vol > 0"),
        "score",
        4
    ).withColumn("iv", 1 / F.col("vol")).withColumn("w", xs.share_of("iv", ["date"])),
    {"w": 6},
    f"v AS (SELECT *, stddev_samp(ret) {q.w(12)} AS vol FROM panel), tk AS (SELECT *, row_number() OVER (PARTITION BY date "
    f"ORDER BY score DESC, ticker) AS place FROM v WHERE score IS NOT NULL AND pos % 4 = 0 AND vol > 0), final AS (SELECT date, ticker, (1 / vol) / "
    f"sum(1 / vol) OVER (PARTITION BY date) AS w FROM tk WHERE place <= 4)",
    _DT
)
_add(
    "top05_top_k_forward",
    lambda d: xs.top_k(d.where("pos % 2 = 0"), "score", 3).where("fwd is not null").groupBy("date").agg(F.avg("fwd").alias("ret")),
    {"ret": 5},
    f"{_TOP}, final AS (SELECT date, avg(fwd) AS ret FROM tk WHERE place <= 3 AND fwd IS NOT NULL GROUP BY date)",
    ("date",)
)
_add(
    "top06_top_pairs",
    lambda d: m.top_pairs(d, "ticker", "ret", "date", 10, 20),
    {"corr": 5},
    "r AS (SELECT * FROM panel WHERE ret IS NOT NULL), p AS (SELECT x.ticker AS a, y.ticker AS b, "
    "CASE WHEN count(*) >= 10 THEN covar_samp(x.ret, y.ret) / (stddev_samp(x.ret) * stddev_samp(y.ret)) END AS corr, count(*) AS n FROM r x "
    "JOIN r y ON x.date = y.date AND x.ticker < y.ticker GROUP BY x.ticker, y.ticker), final AS (SELECT * FROM p "
    "ORDER BY abs(corr) DESC, a, b LIMIT 20)",
    ("a", "b")
)
_add(
    "top07_top_one",
    lambda d: d.where("score is not null").groupBy("date").agg(
        F.max_by(F.struct("ticker", "fwd", "score"), F.struct("score", "ticker")).alias("x")
    ).select("date", "x.ticker", "x.score", "x.fwd"),
    {"score": 6, "fwd": 5},
    "t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker DESC) AS k FROM panel "
    "WHERE score IS NOT NULL), final AS (SELECT * FROM t WHERE k = 1)",
    _DT
)
_add(
    "top08_rank_rows",
    lambda d: d.where("fwd is not null").orderBy(F.col("fwd").desc(), "date", "ticker").limit(50),
    {"fwd": 5},
    "final AS (SELECT * FROM panel WHERE fwd IS NOT NULL ORDER BY fwd DESC, date, ticker LIMIT 50)",
    _DT
)
_add(
    "top09_keep_last",
    lambda d: d.where("px is not null").withColumn(
        "k",
        F.row_number().over(Window.partitionBy("ticker", F.year("date")).orderBy(F.col("date").desc()))
    ).where("k = 1"),
    {"px": 5},
    "t AS (SELECT *, row_number() OVER (PARTITION BY ticker, year(date) ORDER BY date DESC) AS k FROM panel "
    "WHERE px IS NOT NULL), final AS (SELECT * FROM t WHERE k = 1)",
    _DT
)
