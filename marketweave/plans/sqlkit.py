"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

_SPARSE = """
  SELECT date, ticker, min_by(price, sq) AS open, max(price) AS high, min(price) AS low, max_by(price, sq) AS close,
         sum(quantity) AS volume, sum(amount) AS turnover FROM trades GROUP BY date, ticker"""

BRAND = f"""
trades AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS ticker, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice AS amount,
         {{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}} AS sq
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sparse AS ({_SPARSE}),
dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM sparse)),
shares AS (SELECT p_brand AS ticker, sum(p_retailprice) AS shares_outstanding FROM part GROUP BY p_brand),
bars AS (
  SELECT d.date, d.pos, t.ticker, s.open, s.high, s.low, s.close, s.volume, s.turnover, h.shares_outstanding, s.close * h.shares_outstanding AS mkt_cap
  FROM dates d CROSS JOIN (SELECT DISTINCT ticker FROM sparse) t LEFT JOIN sparse s ON s.date = d.date AND s.ticker = t.ticker LEFT JOIN shares h ON h.ticker = t.ticker)"""

NATION = f"""
trades AS (
  SELECT CAST(l_shipdate AS DATE) AS date, n_name AS ticker, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice AS amount,
         {{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}} AS sq
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
sparse AS ({_SPARSE}),
dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM sparse)),
bars AS (
  SELECT d.date, d.pos, t.ticker, s.open, s.high, s.low, s.close, s.volume, s.turnover
  FROM dates d CROSS JOIN (SELECT DISTINCT ticker FROM sparse) t LEFT JOIN sparse s ON s.date = d.date AND s.ticker = t.ticker),
sectors AS (SELECT n_name AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)"""

TS = "PARTITION BY ticker ORDER BY date"


def w(n: int | None = None, by: str = TS) -> str:
    return f"OVER ({by} ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND CURRENT ROW)"


def fw(a: int, b: int, by: str = TS) -> str:
    return f"OVER ({by} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"


def ref(x: str, k: int = 1, by: str = TS) -> str:
    return x if k == 0 else f"lag({x}, {k}) OVER ({by})" if k > 0 else f"lead({x}, {-k}) OVER ({by})"


def full(agg: str, x: str, n: int, least: int | None = None, by: str = TS) -> str:
    return f"CASE WHEN count({x}) {w(n, by)} >= {n if least is None else least} THEN {agg}({x}) {w(n, by)} END"


def ma(x: str, n: int, **k) -> str:
    return full("avg", x, n, **k)


def std(x: str, n: int, **k) -> str:
    return full("stddev_samp", x, n, **k)


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"


def ffill(x: str, by: str = TS) -> str:
    return f"last_value({x} IGNORE NULLS) {w(None, by)}"


def change(x: str, k: int = 1, by: str = TS) -> str:
    return f"({div(x, ref(x, k, by))} - 1)"


def both(x: str, y: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"


def cov(x: str, y: str, n: int) -> str:
    return f"CASE WHEN count({both(x, y)}) {w(n)} = {n} THEN covar_samp({x}, {y}) {w(n)} END"


def corr(x: str, y: str, n: int) -> str:
    scale = f"(stddev_samp({x}) {w(n)} * stddev_samp({y}) {w(n)})"
    return f"CASE WHEN count({both(x, y)}) {w(n)} = {n} AND abs({scale}) > 1e-12 THEN covar_samp({x}, {y}) {w(n)} / {scale} END"


def ts_rank(x: str, n: int) -> str:
    values = f"list_filter(list({x}) {w(n)}, lambda v: v IS NOT NULL)"
    return (
        f"CASE WHEN count({x}) {w(n)} = {n} THEN (len(list_filter({values}, lambda v: v < {x})) + (len(list_filter({values}, lambda v: v = {x})) + "
        f"1) / 2.0) / {n}.0 END"
    )


def cs_rank(x: str, by: str = "date") -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {x} IS NULL "
        f"ORDER BY {x}) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"
    )


def stages(base: str, steps: list[str], final: str, source: str = "bars") -> str:
    """A query over base whose steps each add columns to the one before; final selects from the last as s."""
    out, last = [base.strip()], source
    for i, step in enumerate(steps):
        out.append(f"s{i} AS (SELECT *, {step} FROM {last})")
        last = f"s{i}"
    return "WITH " + ",\n".join(out) + "\n" + final.replace("{s}", last)


def value_query(steps: list[str], value: str, digits: int = 4, base: str = BRAND) -> str:
    return stages(
        base,
        [*steps, f"{value} AS value"],
        f"SELECT date, ticker, round(value, {digits}) + 0.0 AS value FROM {{s}} WHERE value IS NOT NULL"
    )


PANEL = f"""{BRAND},
px0 AS (SELECT date, pos, ticker, volume, shares_outstanding, round(turnover / nullif(volume, 0), 6) AS px FROM bars),
panel AS (
  SELECT *, {change('px')} AS ret, {change('px', 4)} AS score, {div(ref('px', -3), ref('px', -1))} - 1 AS fwd, px * shares_outstanding AS mcap,
         'S' || CAST(CAST(regexp_extract(ticker, '[0-9]+') AS INTEGER) % 5 AS VARCHAR) AS sector
  FROM px0)"""


def bucket(x: str, n: int, usable: str | None = None) -> tuple[str, str]:
    """Two steps that end in the column bucket: equal counts by quantile edges, ties by ticker."""
    u = usable or f"{x} IS NOT NULL"
    return (
        f"row_number() OVER (PARTITION BY date, {u} ORDER BY {x}, ticker) - 1 AS bi, count(CASE WHEN {u} THEN 1 END) OVER (PARTITION BY date) AS bm",
        f"CASE WHEN {u} AND bm >= {n} THEN least({n - 1}, (bi * {n}) // greatest(bm - 1, 1)) + 1 END AS bucket",
    )


def walk(name: str, rows: str, first: dict[str, str], step: dict[str, str], key: str = "ticker", order: str = "date") -> str:
    """A table that walks each key's rows in order with a state: first from row n, step from the state before (s) and row n."""
    same = " AND ".join(f"n.{k} = s.{k}" for k in key.split(", "))
    begin, go = (", ".join(f"{v} AS {k}" for k, v in d.items()) for d in (first, step))
    return f"""{name}_rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {rows}),
{name} AS (SELECT n.*, {begin} FROM {name}_rows n WHERE rn = 1 UNION ALL SELECT n.*, {go} FROM {name} s JOIN {name}_rows n ON {same} AND n.rn = s.rn + 1)"""


def ewm(name: str, rows: str, x: str, alpha: float, least: int, out: str, key: str = "ticker", order: str = "date") -> str:
    """rows with the exponential mean of x without adjustment, where gaps go on decaying, as a table `name`."""
    keep = 1 - alpha
    first = {"wt": f"CAST(n.{x} AS DOUBLE)", "ow": "CAST(1 AS DOUBLE)", "nobs": f"CASE WHEN n.{x} IS NULL THEN 0 ELSE 1 END"}
    step = {
        "wt": f"CASE WHEN s.wt IS NULL THEN n.{x} WHEN n.{x} IS NULL THEN s.wt ELSE (s.ow * {keep} * s.wt + {alpha} * n.{x}) / (s.ow * {keep} + {alpha}) "
        f"END",
        "ow": f"CASE WHEN s.wt IS NULL OR n.{x} IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE s.ow * {keep} END",
        "nobs": f"s.nobs + CASE WHEN n.{x} IS NULL THEN 0 ELSE 1 END",
    }
    return (
        f"{walk(f'{name}_w', rows, first, step, key, order)},\n{name} AS (SELECT * EXCLUDE (wt, ow, nobs, rn), "
        f"CASE WHEN nobs >= {least} THEN wt END AS {out} FROM {name}_w)"
    )


def recursive(sql: str) -> str:
    """sql, told that it holds a walk if it does."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if "UNION ALL SELECT n.*" in sql else sql


def rsi(name: str, rows: str, x: str, n: int) -> str:
    """rows with Wilder's relative strength index of x, as a table `name`."""
    diff = (
        f"{name}_d AS (SELECT *, {x} - {ref(x)} AS df FROM {rows}), {name}_u AS (SELECT *, "
        f"CASE WHEN df > 0 THEN df WHEN df IS NOT NULL THEN 0.0 END AS up, CASE WHEN df < 0 THEN -df WHEN df IS NOT NULL THEN 0.0 END AS dn "
        f"FROM {name}_d)"
    )
    means = f"{ewm(f'{name}_g', f'{name}_u', 'up', 1 / n, n, 'gain')}, {ewm(f'{name}_l', f'{name}_g', 'dn', 1 / n, n, 'loss')}"
    return (
        f"{diff}, {means}, {name} AS (SELECT *, CASE WHEN loss = 0 AND gain > 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END AS rsi "
        f"FROM {name}_l)"
    )


def rsi_query(n: int) -> str:
    return (
        f"WITH RECURSIVE {BRAND}, base AS (SELECT date, ticker, close FROM bars), {rsi('r', 'base', 'close', n)} "
        f"SELECT date, ticker, round(rsi, 4) + 0.0 AS value FROM r WHERE rsi IS NOT NULL"
    )
