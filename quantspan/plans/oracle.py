"""The same results in plain SQL: dense frames, cross joins and day-by-day paths.

Written the long way on purpose. Where the transforms stay sparse, group before they
join, or look at blocks instead of days, the SQL spells every cell out, so agreement
says something.
"""

from __future__ import annotations

import math

# Written out, not imported: the queries have their own.
EULER_GAMMA = 0.5772156649
# Coefficients of the rational approximation of the normal quantile.
PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PROBIT_TAIL = 0.02425
SAMPLE_A, SPLIT = ("1-URGENT", "2-HIGH", "3-MEDIUM"), "1998-06-30"
BRAND_LEVEL, PNL_SCALE, PRIORITY_LEVEL = 1_000_000.0, 1999.0, 5_000_000.0

KINDS = ("nonpositive_price", "anomalous_return", "session_gap")


def final(columns: str, source: str, where: str = "") -> str:
    """Select `columns`; a trailing * marks a double, rounded to six decimals."""
    picked = ", ".join(
        f"round({c[:-1]}, 6) + 0.0 AS {c[:-1]}" if c.endswith("*") else c for c in columns.split()
    )
    return f"SELECT {picked} FROM {source}" + (f" WHERE {where}" if where else "")


def with_(*parts: str) -> str:
    ctes = [p for p in parts[:-1] if p]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + parts[-1]


# --- inputs -----------------------------------------------------------------------------
PRIORITY = f"""prices AS (
  SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS dt,
         {PRIORITY_LEVEL} + avg(o_totalprice) AS close
  FROM orders GROUP BY 1, 2)"""
BRAND = f"""prices AS (
  SELECT p_brand AS instrument, CAST(l_shipdate AS DATE) AS dt,
         {BRAND_LEVEL} + avg(l_extendedprice) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
ORDER_BARS = """raw AS (
  SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS dt, o_orderkey AS ord,
         o_totalprice AS close FROM orders)"""
BALANCE_BARS = """raw AS (
  SELECT c_mktsegment AS instrument, CAST(o_orderdate AS DATE) AS dt, o_orderkey AS ord,
         c_acctbal AS close FROM orders JOIN customer ON o_custkey = c_custkey)"""
EVENT_BARS = """raw AS (
  SELECT printf('U%05d', user_id) AS instrument, CAST(ts AS DATE) AS dt, event_id AS ord,
         value AS close FROM events)"""
LAST_BAR = """lastbar AS (
  SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY instrument, dt ORDER BY ord DESC) = 1)"""
CLEAN = """bars AS (
  SELECT * FROM raw WHERE isodow(dt) <= 5
  QUALIFY row_number() OVER (PARTITION BY instrument, dt ORDER BY ord DESC) = 1)"""
OHLC = """bars AS (
  SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS dt,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close
  FROM orders GROUP BY 1, 2)"""
EVENT_OHLC = """bars AS (
  SELECT printf('U%05d', user_id) AS instrument, CAST(ts AS DATE) AS dt,
         arg_min(value, event_id) AS open, arg_max(value, event_id) AS close
  FROM events WHERE isodow(CAST(ts AS DATE)) <= 5 GROUP BY 1, 2)"""

# --- frames -------------------------------------------------------------------------------
CAL = """cal AS (
  SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS pos, lag(dt) OVER (ORDER BY dt) AS prev_dt,
         min(dt) OVER () AS lo, max(dt) OVER () AS hi
  FROM (SELECT DISTINCT dt FROM prices))"""
FRAME = """frame AS (
  SELECT i.instrument, c.dt, c.pos, p.close,
         last_value(p.close IGNORE NULLS) OVER (PARTITION BY i.instrument ORDER BY c.dt
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
  FROM cal c CROSS JOIN (SELECT DISTINCT instrument FROM prices) i
  LEFT JOIN prices p ON p.instrument = i.instrument AND p.dt = c.dt)"""
RETS = """rets AS (
  SELECT instrument, dt, coalesce(filled / nullif(lag(filled) OVER (PARTITION BY instrument ORDER BY dt), 0) - 1, 0) AS ret
  FROM frame)"""
FRAMED = (CAL, FRAME, RETS)
HOLD_W = """wts AS (
  SELECT instrument, dt, 1.0::DOUBLE / (SELECT count(DISTINCT instrument) FROM prices) AS w FROM frame)"""
SHARE_W = """wts AS (
  SELECT instrument, dt, close / sum(abs(close)) OVER (PARTITION BY dt) AS w FROM prices)"""
LAST_SIGN_W = """wts AS (
  SELECT instrument, dt, coalesce(sign(lag(ret) OVER (PARTITION BY instrument ORDER BY dt)), 0) * 0.25::DOUBLE AS w FROM rets)"""
NO_COSTS = "costs AS (SELECT '' AS instrument, 0.0::DOUBLE AS rate, 0.0::DOUBLE AS swap WHERE false)"
COSTS = """costs AS (
  SELECT o_orderpriority AS instrument,
         avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)::DOUBLE * 1e-3 AS spread,
         avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END)::DOUBLE * 1e-3 AS slippage,
         avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END)::DOUBLE * 1e-3 AS impact,
         avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END)::DOUBLE * 1e-4 AS swap,
         avg(CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN 1.0 ELSE 0.0 END)::DOUBLE * 1e-3 AS rate
  FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)"""
DENSE_W = """dense AS (
  SELECT f.instrument, f.dt, coalesce(v.w, 0) AS w,
         coalesce(lag(coalesce(v.w, 0)) OVER (PARTITION BY f.instrument ORDER BY f.dt), 0) AS held
  FROM frame f LEFT JOIN wts v ON v.instrument = f.instrument AND v.dt = f.dt)"""
DAILY = """daily AS (
  SELECT d.dt, sum(d.held * r.ret) AS gross, sum(abs(d.w - d.held)) AS turnover,
         sum(abs(d.w - d.held) * coalesce(c.rate, 0.00015)) AS turnover_cost,
         sum(abs(d.held)) AS held, sum(abs(d.held) * coalesce(c.swap, 0.00003)) AS swap_cost
  FROM dense d JOIN rets r ON r.instrument = d.instrument AND r.dt = d.dt
  LEFT JOIN costs c ON c.instrument = d.instrument GROUP BY d.dt)"""
NET = "series AS (SELECT dt, gross - turnover_cost - swap_cost AS ret FROM daily)"
GROSS = "series AS (SELECT dt, gross AS ret FROM daily)"


def backtest_of(prices: str, weights: str, costs: str = NO_COSTS, series: str = NET) -> tuple[str, ...]:
    return (prices, *FRAMED, weights, costs, DENSE_W, DAILY, series)


HELD = backtest_of(PRIORITY, HOLD_W)
PER_YEAR = """(CASE WHEN count(ret) >= 2 AND max(dt) FILTER (ret IS NOT NULL) > min(dt) FILTER (ret IS NOT NULL)
  THEN count(ret) / ((max(dt) FILTER (ret IS NOT NULL) - min(dt) FILTER (ret IS NOT NULL)) / 365.25)
  ELSE 252.0 END)"""
SHARPE = f"coalesce(sqrt({PER_YEAR}) * avg(ret) / nullif(stddev_pop(ret), 0), 0)"
EQUITY = "eq AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (ORDER BY dt) AS equity FROM series)"
DD = "dd AS (SELECT *, equity / max(equity) OVER (ORDER BY dt) - 1 AS drawdown FROM eq)"

OWN = """own AS (
  SELECT instrument, dt, close, lag(close) OVER w AS before,
         close / nullif(lag(close) OVER w, 0) - 1 AS own_ret
  FROM prices WINDOW w AS (PARTITION BY instrument ORDER BY dt))"""


def own_vol(per_year: str | None = None) -> str:
    """Own-day rolling volatility, from every instrument's own bars per year."""
    own_year = per_year or (
        "(SELECT count(*) / ((max(x.dt) - min(x.dt)) / 365.25) FROM own x"
        " WHERE x.instrument = own.instrument AND x.before IS NOT NULL)"
    )
    return f"""ann AS (SELECT DISTINCT instrument, {own_year} AS per_year FROM own),
fullvol AS (
  SELECT o.*, CASE WHEN count(own_ret) OVER w = 63 THEN stddev_samp(own_ret) OVER w END * sqrt(per_year) AS now_vol
  FROM own o JOIN ann USING (instrument)
  WINDOW w AS (PARTITION BY instrument ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
ownvol AS (
  SELECT * EXCLUDE (now_vol), last_value(now_vol IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY dt ROWS UNBOUNDED PRECEDING) AS vol
  FROM fullvol)"""


def sized(direction: str, per_year: str | None = None) -> str:
    """From ownvol plus a `direction` column: raw, relative and scaled weights on the frame."""
    span = per_year or "(SELECT count(*) / ((max(dt) - min(dt)) / 365.25) FROM cal)"
    return f"""raws AS (
  SELECT f.instrument, f.dt, coalesce(v.direction / nullif(v.vol, 0), 0) AS raw
  FROM frame f LEFT JOIN ({direction}) v ON v.instrument = f.instrument AND v.dt = f.dt),
rel AS (
  SELECT instrument, dt, coalesce(raw / nullif(sum(abs(raw)) OVER (PARTITION BY dt), 0), 0) AS rel FROM raws),
rellag AS (
  SELECT *, coalesce(lag(rel) OVER (PARTITION BY instrument ORDER BY dt), 0) AS before FROM rel),
port AS (
  SELECT l.dt, sum(l.before * r.ret) AS port_ret FROM rellag l
  JOIN rets r ON r.instrument = l.instrument AND r.dt = l.dt GROUP BY l.dt),
portvol AS (
  SELECT dt, port_ret, CASE WHEN count(port_ret) OVER w = 63 THEN stddev_samp(port_ret) OVER w END * sqrt({span}) AS vol
  FROM port WINDOW w AS (ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
scalars AS (
  SELECT dt, port_ret, lag(vol) OVER (ORDER BY dt) AS port_vol, 0.08 / nullif(lag(vol) OVER (ORDER BY dt), 0) AS scalar
  FROM portvol),
scaled AS (SELECT instrument, dt, coalesce(rel * scalar, 0) AS w FROM rel JOIN scalars USING (dt)),
capped AS (
  SELECT instrument, dt, w * CASE WHEN gross > 4 THEN 4 / gross ELSE 1 END AS w, gross > 4 AS over
  FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY dt) AS gross FROM scaled))"""


def momentum_direction(months: int) -> str:
    return f"""SELECT a.instrument, a.dt, a.vol, sign(a.close / b.close - 1) AS direction
  FROM (SELECT *, dt - INTERVAL {months} MONTH AS probe FROM ownvol) a
  ASOF LEFT JOIN prices b ON a.instrument = b.instrument AND a.probe >= b.dt"""


MONTH_STARTS = """starts AS (
  SELECT min(d) AS rebalance_dt FROM (
    SELECT unnest(generate_series(date_trunc('month', min(dt)), max(dt), INTERVAL 1 DAY))::DATE AS d FROM prices)
  WHERE isodow(d) <= 5 GROUP BY date_trunc('month', d)),
rebalances AS (
  SELECT s.rebalance_dt, (SELECT max(dt) FROM cal WHERE dt <= s.rebalance_dt) AS source_dt
  FROM starts s WHERE s.rebalance_dt BETWEEN (SELECT min(dt) FROM prices) AND (SELECT max(dt) FROM prices)),
holds AS (
  SELECT c.dt, r.rebalance_dt, r.source_dt FROM cal c ASOF LEFT JOIN rebalances r ON c.dt >= r.rebalance_dt)"""
HELD_W = """wts AS (
  SELECT f.instrument, f.dt, coalesce(k.w, 0) AS w FROM frame f JOIN holds h ON h.dt = f.dt
  LEFT JOIN capped k ON k.instrument = f.instrument AND k.dt = h.source_dt)"""


def momentum(prices: str, months: int = 12, per_year: str | None = None) -> tuple[str, ...]:
    return (
        prices, *FRAMED, OWN, own_vol(per_year), sized(momentum_direction(months), per_year), MONTH_STARTS, HELD_W
    )


# --- histories ------------------------------------------------------------------------------
STEPS = f"""steps AS (
  SELECT user_id, row_number() OVER w AS day, r, sum(r) OVER w AS pnl FROM (
    SELECT user_id, ts, event_id, (value - avg(value) OVER (PARTITION BY user_id)) / {PNL_SCALE} AS r FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


# Values that the queries must use, spelled out.
LEVERAGES = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0)
EVAL_START = {"A": "1996-01-01", "B": "1997-01-01"}


def passage(target: float, k: float = 1.0, source: str = "steps", key: str = "user_id") -> str:
    return f"""SELECT {key}, {k}::DOUBLE AS k,
  CASE WHEN loss <= coalesce(gain, loss) THEN 'FAILED' WHEN gain IS NOT NULL THEN 'PASSED' ELSE 'UNRESOLVED' END AS outcome,
  coalesce(least(gain, loss), horizon) AS day
  FROM (SELECT {key}, max(day) AS horizon, min(day) FILTER (pnl * {k} >= {target}) AS gain,
    min(day) FILTER (r * {k} <= -0.05 OR pnl * {k} <= -0.10) AS loss
    FROM {source} GROUP BY {key})"""


def resampled(n_paths: int, horizon: int) -> str:
    """Every day of every path, from `series`, in blocks of 20 with seed 12345."""
    return f"""ser AS (
  SELECT row_number() OVER (ORDER BY dt) - 1 AS idx, count(*) OVER () AS n, ret FROM series),
days AS (
  SELECT 1 AS phase, path, day, (('0x' || substr(md5(concat_ws('|', 12345, 1, path, (day - 1) // 20)), 1, 8))::BIGINT
      + (day - 1) % 20) % (SELECT count(*) FROM series) AS idx
  FROM range({n_paths}) p(path), range(1, {horizon} + 1) d(day)),
walks AS (
  SELECT phase, path, day, ret AS r, sum(ret) OVER (PARTITION BY phase, path ORDER BY day ROWS UNBOUNDED PRECEDING) AS pnl
  FROM days JOIN ser USING (idx))"""


# --- study: one set of frames per sample and lookback -----------------------------------------
def study() -> str:
    """Daily series per sample and lookback from the live start, as `daily_all`."""
    members = {"A": "WHERE instrument IN (" + ", ".join(f"'{m}'" for m in SAMPLE_A) + ")", "B": ""}
    blocks = []
    for panel, condition in members.items():
        for months in (12, 6):
            base = PRIORITY.replace("prices AS (", "allprices AS (")
            inner = with_(
                base,
                f"prices AS (SELECT * FROM allprices {condition})",
                *momentum("", months)[1:],
                NO_COSTS,
                DENSE_W,
                DAILY,
                f"SELECT '{panel}' AS panel, {months} AS lookback, * FROM daily WHERE dt >="
                f" greatest(DATE '{EVAL_START[panel]}', (SELECT min(dt) FROM daily WHERE turnover > 0))",
            )
            blocks.append(f"SELECT * FROM ({inner})")
    union = "\nUNION ALL\n".join(blocks)
    return f"daily_all AS MATERIALIZED ({union})"


TRIALS = f"""trials AS (
  SELECT panel, lookback, swap_bp, {SHARPE} AS sharpe
  FROM (SELECT panel, lookback, swap_bp, dt, gross - turnover_cost - held * swap_bp * 1e-4 AS ret
        FROM daily_all, (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (1.0::DOUBLE)) s(swap_bp))
  GROUP BY 1, 2, 3)"""
COUNTED = "counted AS (SELECT panel, lookback, sharpe FROM trials WHERE swap_bp = 0.3)"


def ppf(p: str) -> str:
    def poly(cs, x, last=None):
        out = str(cs[0])
        for c in (*cs[1:], *([last] if last is not None else [])):
            out = f"({out}) * {x} + {c!r}"
        return f"({out})"

    def tail(q):
        return f"({poly(PROBIT_C, q)} / {poly(PROBIT_D, q, 1.0)})"

    mid, sq = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (
        f"(CASE WHEN {p} < {PROBIT_TAIL} THEN {tail(low)} WHEN {p} > {1 - PROBIT_TAIL} THEN -{tail(high)}"
        f" ELSE {poly(PROBIT_A, sq)} * {mid} / {poly(PROBIT_B, sq, 1.0)} END)"
    )


def deflation(source: str, by: str = "") -> str:
    """`deflated`: best of the trials in `source` less the expected best under the null."""
    g = EULER_GAMMA
    luck = f"sd * ((1 - {g}) * {ppf('p1')} + {g} * {ppf('p2')})"
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""pool AS (
  SELECT {head}count(*) AS n_trials, max(sharpe) AS best, stddev_samp(sharpe) AS sd,
         1 - 1.0 / count(*) AS p1, 1 - 1.0 / (count(*) * {math.e!r}) AS p2 FROM {source} {group}),
deflated AS (
  SELECT {head}n_trials, best, CASE WHEN n_trials < 2 THEN 0 ELSE {luck} END AS expected_max,
         best - CASE WHEN n_trials < 2 THEN 0 ELSE {luck} END AS deflated FROM pool)"""


# --- turn of month -----------------------------------------------------------------------------
def tom(after: int = 3) -> str:
    return f"""flags AS (
  SELECT instrument, dt, dt IN (SELECT max(x.dt) FROM prices x WHERE x.instrument = prices.instrument
            AND date_trunc('month', x.dt) = date_trunc('month', prices.dt))
         OR row_number() OVER (PARTITION BY instrument, date_trunc('month', dt) ORDER BY dt) <= {after} AS tom
  FROM prices)"""


TOM_DIRECTION = (
    "SELECT v.instrument, v.dt, v.vol, CAST(g.tom AS INTEGER) AS direction"
    " FROM ownvol v JOIN flags g ON g.instrument = v.instrument AND g.dt = v.dt"
)
CAPPED_W = "wts AS (SELECT instrument, dt, w FROM capped)"


def tom_series(after: int = 3, name: str = "series") -> tuple[str, ...]:
    return (
        PRIORITY, *FRAMED, OWN, own_vol(), tom(after), sized(TOM_DIRECTION), CAPPED_W, NO_COSTS, DENSE_W, DAILY,
        f"{name} AS (SELECT dt, gross - turnover_cost - swap_cost AS ret FROM daily)",
    )


def contrast(n_paths: int) -> str:
    """Day-by-day resamples of each instrument's and the pooled contrast."""
    return f"""flagged AS (
  SELECT o.instrument, o.dt, o.own_ret AS ret, g.tom FROM own o JOIN flags g USING (instrument, dt) WHERE own_ret IS NOT NULL),
cells AS (
  SELECT instrument, dt, CASE WHEN tom THEN ret ELSE 0 END AS s1, CASE WHEN tom THEN 1 ELSE 0 END AS n1,
         CASE WHEN tom THEN 0 ELSE ret END AS s0, CASE WHEN tom THEN 0 ELSE 1 END AS n0 FROM flagged
  UNION ALL
  SELECT 'ALL', dt, sum(CASE WHEN tom THEN ret ELSE 0 END), count(*) FILTER (tom),
         sum(CASE WHEN tom THEN 0 ELSE ret END), count(*) FILTER (NOT tom) FROM flagged GROUP BY dt),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY dt) - 1 AS idx, count(*) OVER (PARTITION BY instrument) AS n FROM cells),
picks AS (
  SELECT m.instrument, path, (('0x' || substr(md5(concat_ws('|', 12345, path, m.idx // 20)), 1, 8))::BIGINT + m.idx % 20) % m.n AS idx
  FROM numbered m, range({n_paths}) p(path)),
drawn AS (
  SELECT instrument, path, sum(s1) / sum(n1) - sum(s0) / sum(n0) AS d FROM picks JOIN numbered USING (instrument, idx) GROUP BY 1, 2),
contrast AS (
  SELECT instrument, (SELECT sum(s1) / sum(n1) - sum(s0) / sum(n0) FROM cells c WHERE c.instrument = drawn.instrument) * 1e4 AS contrast_bp,
         stddev_samp(d) * 1e4 AS se_bp, quantile_cont(d, 0.025) * 1e4 AS ci_low_bp, quantile_cont(d, 0.975) * 1e4 AS ci_high_bp
  FROM drawn GROUP BY instrument)"""


def random_portfolios(n: int, k: int = 4) -> tuple[str, ...]:
    """Sharpe per resample (`nulls`), every frame cell of every resample spelled out."""
    return (
        "direct AS (SELECT instrument, dt, vol, 1 AS direction FROM ownvol)",
        """nraw AS (
  SELECT f.instrument, f.dt, f.pos, coalesce(1 / nullif(v.vol, 0), 0) AS raw FROM frame f
  LEFT JOIN ownvol v ON v.instrument = f.instrument AND v.dt = f.dt)""",
        """nrel AS (
  SELECT *, coalesce(raw / nullif(sum(raw) OVER (PARTITION BY dt), 0), 0) AS rel FROM nraw)""",
        """months AS (
  SELECT date_trunc('month', dt)::DATE AS month, count(*) AS n, min(pos) AS first FROM cal GROUP BY 1)""",
        f"""stepped AS (
  SELECT path, month, n, first, i,
    ('0x' || substr(md5(concat_ws('|', 12345, path, strftime(month, '%Y-%m-%d'), n - {k} + i)), 1, 8))::BIGINT % (n - {k} + i + 1) AS t
  FROM months, range({n}) p(path), range({k}) s(i) WHERE n - {k} + i >= 0)""",
        "c0 AS (SELECT path, month, first, max(n) AS n, "
        + ", ".join(f"max(CASE i WHEN {i} THEN t END) AS t{i}" for i in range(k))
        + ", max(CASE i WHEN 0 THEN t END) AS p0 FROM stepped GROUP BY 1, 2, 3)",
        *[
            f"c{i} AS (SELECT *, CASE WHEN "
            + " OR ".join(f"t{i} = p{j}" for j in range(i))
            + f" THEN n - {k} + {i} ELSE t{i} END AS p{i} FROM c{i - 1})"
            for i in range(1, k)
        ],
        f"""chosen AS (
  SELECT path, dt FROM (SELECT path, first + unnest([{", ".join(f"p{i}" for i in range(k))}]) AS pos FROM c{k - 1}) JOIN cal USING (pos))""",
        f"""ncell AS (
  SELECT path, r.instrument, r.dt, CASE WHEN c.dt IS NULL THEN 0 ELSE r.rel END AS rel
  FROM nrel r CROSS JOIN range({n}) p(path) LEFT JOIN chosen c USING (path, dt))""",
        """nlag AS (
  SELECT *, coalesce(lag(rel) OVER (PARTITION BY path, instrument ORDER BY dt), 0) AS before FROM ncell)""",
        """nport AS (
  SELECT path, dt, sum(before * ret) AS port_ret FROM nlag JOIN rets USING (instrument, dt) GROUP BY 1, 2)""",
        """nvol AS (
  SELECT path, dt, CASE WHEN count(port_ret) OVER w = 63 THEN stddev_samp(port_ret) OVER w END
    * sqrt((SELECT count(*) / ((max(dt) - min(dt)) / 365.25) FROM cal)) AS vol FROM nport
  WINDOW w AS (PARTITION BY path ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))""",
        """nscalar AS (
  SELECT path, dt, CASE WHEN x > 4 THEN 4.0 ELSE x END AS s FROM (
    SELECT path, dt, 0.08 / nullif(lag(vol) OVER (PARTITION BY path ORDER BY dt), 0) AS x FROM nvol))""",
        """nw AS (
  SELECT path, instrument, dt, coalesce(rel * s, 0) AS w FROM ncell JOIN nscalar USING (path, dt))""",
        """nheld AS (
  SELECT *, coalesce(lag(w) OVER (PARTITION BY path, instrument ORDER BY dt), 0) AS held FROM nw)""",
        """nseries AS (
  SELECT path, dt, sum(held * ret - abs(w - held) * 0.00015 - abs(held) * 0.00003) AS ret
  FROM nheld JOIN rets USING (instrument, dt) GROUP BY 1, 2)""",
        f"nulls AS (SELECT path AS resample, {SHARPE} AS sharpe FROM nseries GROUP BY path)",
    )


ANOMALIES = """logs AS (
  SELECT *, ln(CASE WHEN close > 0 THEN close END)
    - lag(ln(CASE WHEN close > 0 THEN close END)) OVER (PARTITION BY instrument ORDER BY dt) AS log_ret FROM bars),
zs AS (
  SELECT *, (log_ret - avg(log_ret) OVER (PARTITION BY instrument)) / nullif(stddev_pop(log_ret) OVER (PARTITION BY instrument), 0) AS z
  FROM logs)"""
OPEN_GAPS = """gaps AS (
  SELECT *, ln(CASE WHEN open > 0 THEN open END / CASE WHEN before > 0 THEN before END) AS open_gap
  FROM (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY dt) AS before FROM bars)),
gapz AS (
  SELECT *, (open_gap - avg(open_gap) OVER (PARTITION BY instrument)) / nullif(stddev_pop(open_gap) OVER (PARTITION BY instrument), 0) AS z
  FROM gaps)"""
MISSING = """missing AS (
  SELECT instrument, d AS dt FROM (
    SELECT instrument, unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY))::DATE AS d FROM bars GROUP BY instrument)
  WHERE isodow(d) <= 5 AND (instrument, d) NOT IN (SELECT (instrument, dt) FROM bars))"""
DUPLICATES = """dups AS (
  SELECT instrument, count(*) > count(DISTINCT dt) AS has_duplicates FROM raw GROUP BY instrument)"""
FOUND = """found AS (
  SELECT instrument, dt, 'nonpositive_price' AS kind, 1 AS kr FROM bars WHERE close <= 0 OR close IS NULL
  UNION ALL SELECT instrument, dt, 'anomalous_return', 2 FROM zs WHERE abs(z) > {sigma})"""

ORACLE: dict[str, str] = {}


def _put(name: str, *parts: str) -> None:
    ORACLE[name] = with_(*parts)


# --- sources -------------------------------------------------------------------------------------
_put("raw_scan", ORDER_BARS, final("instrument dt close*", "raw"))
_put("clean_sink", ORDER_BARS, CLEAN, final("instrument dt close*", "bars"))
_put("panel_scan", ORDER_BARS, CLEAN, "SELECT 'orders' AS panel, instrument, dt, round(close, 6) + 0.0 AS close FROM bars")
_put(
    "quality_sink", BALANCE_BARS, CLEAN, ANOMALIES, MISSING, FOUND.format(sigma=5.0),
    """SELECT b.instrument, count(*) AS n_obs, min(b.dt) AS start, max(b.dt) AS "end",
      (SELECT count(*) FROM missing m WHERE m.instrument = b.instrument) AS missing_days,
      (SELECT count(*) FROM found f WHERE f.instrument = b.instrument) AS listed,
      greatest(0, (SELECT count(*) FROM found f WHERE f.instrument = b.instrument) - 200) AS more
    FROM bars b GROUP BY b.instrument""",
)
_put(
    "report_sink", *HELD, EQUITY,
    f"""SELECT 'priority' AS panel, count(ret) AS n_obs, round({SHARPE}, 6) + 0.0 AS sharpe,
      round(arg_max(equity, dt), 6) + 0.0 AS final_equity,
      CAST(ceil(count(*) / greatest(1, count(*) // 20)) AS BIGINT) AS points, count(*) AS binned FROM eq""",
)
_put("candle_decode", OHLC, final("instrument dt open* high* low* close*", "bars"))
_put(
    "symbol_map_check",
    "SELECT DISTINCT p_brand AS instrument FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)",
)
_put(
    "month_spine", ORDER_BARS,
    """SELECT instrument, CAST(unnest(generate_series(date_trunc('month', min(dt)), date_trunc('month', max(dt)), INTERVAL 1 MONTH)) AS DATE) AS month
    FROM raw GROUP BY instrument""",
)
_put(
    "ingest_merge",
    """both_ AS (
  SELECT CAST(o_orderdate AS DATE) AS dt, o_orderkey AS ord, o_totalprice AS close, 1 AS batch FROM orders
  UNION ALL SELECT CAST(o_orderdate AS DATE), o_orderkey, c_acctbal, 0 FROM orders JOIN customer ON o_custkey = c_custkey)""",
    """SELECT 'ALL' AS instrument, dt, round(close, 6) + 0.0 AS close FROM both_
    QUALIFY row_number() OVER (PARTITION BY dt ORDER BY batch DESC, ord DESC) = 1""",
)

_put(
    "ingest_upsert",
    """both_ AS (
  SELECT CAST(o_orderdate AS DATE) AS dt, o_orderkey AS ord, o_totalprice AS close, 1 AS batch FROM orders WHERE year(o_orderdate) >= 1997
  UNION ALL SELECT CAST(o_orderdate AS DATE), o_orderkey, c_acctbal, 0 FROM orders JOIN customer ON o_custkey = c_custkey)""",
    """SELECT 'ALL' AS instrument, dt, round(close, 6) + 0.0 AS close FROM both_
    QUALIFY row_number() OVER (PARTITION BY dt ORDER BY batch DESC, ord DESC) = 1""",
)

_put("instrument_from_path", "SELECT page_id, upper(regexp_replace(regexp_extract(url, '[^/]*$'), '[.][^.]*$', '')) AS instrument FROM pages")
_put("raw_glob", "SELECT DISTINCT o_orderpriority AS instrument FROM orders")
_put(
    "price_column_normalise",
    "SELECT 'X' AS instrument, CAST(o_orderdate AS DATE) AS dt, round(o_totalprice + 1, 6) + 0.0 AS open, round(o_totalprice, 6) + 0.0 AS close FROM orders",
)
_put(
    "close_resolve",
    "SELECT 'X' AS instrument, CAST(l_shipdate AS DATE) AS dt, count(*) AS n, round(sum(l_extendedprice), 6) + 0.0 AS total FROM lineitem GROUP BY 2",
)

# --- projections -----------------------------------------------------------------------------------
_put("weekday_filter", ORDER_BARS, final("instrument dt ord close*", "raw", "isodow(dt) <= 5"))
_put("positive_log", BALANCE_BARS, "SELECT ord, round(ln(CASE WHEN close > 0 THEN close END), 6) + 0.0 AS log_close FROM raw")
_put("finite_or_zero", "SELECT o_orderkey, round(CASE WHEN o_orderkey = 0 THEN 0 ELSE o_totalprice / o_orderkey END, 6) + 0.0 AS per_key FROM orders")
_put("direction_sign", "SELECT c_custkey, CAST(sign(c_acctbal) AS DOUBLE) + 0.0 AS direction FROM customer")
_put(
    "months_before", ORDER_BARS,
    "SELECT DISTINCT dt, " + ", ".join(f"CAST(dt - INTERVAL {k} MONTH AS DATE) AS before_{k}" for k in (1, 6, 12)) + " FROM raw",
)
_put(
    "business_month_start", ORDER_BARS,
    """SELECT DISTINCT dt, (SELECT min(d) FROM (SELECT CAST(date_trunc('month', dt) AS DATE) + CAST(i AS INTEGER) AS d FROM range(5) t(i)) WHERE isodow(d) <= 5) AS month_start
    FROM raw""",
)
_put("point_scale", "SELECT o_orderkey AS ord, round(round(o_totalprice * 100) / CASE WHEN o_orderpriority <> '5-LOW' THEN 1000 ELSE 100000 END, 6) + 0.0 AS price FROM orders")
_put("cost_rate", COSTS, "SELECT instrument, round((spread + slippage + impact) * 1e4, 6) + 0.0 AS rate_bp, round(swap * 1e4, 6) + 0.0 AS swap_bp FROM costs")
_put(
    "swap_override", COSTS,
    """SELECT instrument, swap_bp, round(swap_bp * 1e-4, 6) + 0.0 AS swap, round(spread * 1e4, 6) + 0.0 AS spread_bp
    FROM costs, (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (1.0::DOUBLE)) s(swap_bp)""",
)
_put(
    "first_passage_closed_form",
    "m AS (SELECT event_type, avg(value) / 1e6 AS mu, (stddev_pop(value) / 1e3) ** 2 AS v FROM events GROUP BY 1)",
    """SELECT event_type, round((1 - exp(-2 * mu * 0.05 / v)) / (1 - exp(-2 * mu * 0.2 / v)), 6) + 0.0 AS p,
      round(0.05 / (0.05 + 0.15), 6)::DOUBLE + 0.0 AS p_driftless FROM m""",
)
_put(
    "normal_ppf",
    """q AS (SELECT c_nationkey, (tail * n + 0.5) / (n + 1.0) AS p FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
      (VALUES (0.001::DOUBLE), (0.02::DOUBLE), (0.5::DOUBLE), (0.98::DOUBLE), (0.999::DOUBLE)) t(tail))""",
    f"SELECT c_nationkey, round(p, 6) + 0.0 AS p, round({ppf('p')}, 6) + 0.0 AS z FROM q",
)
_put("bucket_label", "SELECT s_suppkey, printf('[%+.4f, %+.4f)', s_acctbal / 777.0, s_acctbal / 777.0 + 0.5) AS label FROM supplier")
_put(
    "window_slice", PRIORITY,
    f"""SELECT instrument, CASE WHEN dt <= DATE '{SPLIT}' THEN 'early' ELSE 'late' END AS period, count(*) AS n,
      min(dt) AS first, max(dt) AS last FROM prices WHERE dt >= DATE '1996-06-01' GROUP BY 1, 2""",
)
_put("holdout_filter", PRIORITY, "SELECT instrument, count(*) AS n, max(dt) AS last FROM prices WHERE dt < DATE '1999-01-01' GROUP BY 1")
_put(
    "phase_rules", STEPS,
    f"""SELECT phase, outcome, count(*) AS n FROM (
      SELECT 1 AS phase, outcome FROM ({passage(0.10)}) UNION ALL SELECT 2, outcome FROM ({passage(0.05)}))
    GROUP BY 1, 2""",
)
_A = ", ".join(f"'{m}'" for m in SAMPLE_A)
_put(
    "universe_filter", PRIORITY,
    f"""SELECT panel, dt, row_number() OVER (PARTITION BY panel ORDER BY dt) - 1 AS pos FROM (
      SELECT DISTINCT 'B' AS panel, dt FROM prices UNION ALL SELECT DISTINCT 'A', dt FROM prices WHERE instrument IN ({_A}))""",
)

# --- alignment ----------------------------------------------------------------------------------------
_put("align_union", PRIORITY, CAL, FRAME, final("instrument dt close* filled*", "frame"))
_put("align_weights", PRIORITY, CAL, FRAME, "SELECT instrument, dt, CASE WHEN close IS NULL THEN 0.0 ELSE 0.2 END::DOUBLE AS w FROM frame")
_put(
    "asof_lookback", PRIORITY,
    """SELECT a.instrument, a.dt, round(a.close, 6) + 0.0 AS close, round(b.close, 6) + 0.0 AS past
    FROM (SELECT *, dt - INTERVAL 12 MONTH AS probe FROM prices) a
    ASOF LEFT JOIN prices b ON a.instrument = b.instrument AND a.probe >= b.dt""",
)
_put("frame_ffill", PRIORITY, CAL, FRAME, "SELECT instrument, dt, round(filled, 6) + 0.0 AS close FROM frame")
_put("calendar_anti", ORDER_BARS.replace("raw AS", "bars AS"), MISSING, "SELECT instrument, dt FROM missing")
_put(
    "cost_lookup", COSTS,
    """SELECT m.instrument, round(coalesce(rate, 0.00015) * 1e4, 6) + 0.0 AS rate_bp, round(coalesce(swap, 0.00003) * 1e4, 6) + 0.0 AS swap_bp
    FROM (SELECT DISTINCT o_orderpriority AS instrument FROM orders) m LEFT JOIN costs USING (instrument)""",
)
_put("rebalance_hold", PRIORITY, CAL, MONTH_STARTS, "SELECT dt, rebalance_dt, source_dt FROM holds")
_put(
    "leverage_grid", STEPS,
    "SELECT k, outcome, count(*) AS n, round(avg(day), 6) + 0.0 AS mean_day FROM ("
    + " UNION ALL ".join(passage(0.10, k) for k in LEVERAGES)
    + ") GROUP BY 1, 2",
)
_put(
    "block_gather", *HELD,
    "ser AS (SELECT row_number() OVER (ORDER BY dt) - 1 AS idx, count(*) OVER () AS n, ret FROM series)",
    """SELECT s.idx AS start, CAST(o.i AS INTEGER) AS "offset", round(t.ret, 6) + 0.0 AS ret
    FROM ser s CROSS JOIN range(20) o(i) JOIN ser t ON t.idx = (s.idx + o.i) % s.n""",
)
_put("trial_grid", study(), TRIALS, final("panel lookback swap_bp* sharpe*", "trials"))

# --- sort, dedup, limit --------------------------------------------------------------------------------
_put("sort_by_date", ORDER_BARS, LAST_BAR, "SELECT instrument, dt, row_number() OVER (PARTITION BY instrument ORDER BY dt) AS rank, round(close, 6) + 0.0 AS close FROM lastbar")
_put("dedup_keep_last", ORDER_BARS, LAST_BAR, final("instrument dt ord close*", "lastbar"))
_put("dup_detect", EVENT_BARS, DUPLICATES, "SELECT instrument, has_duplicates FROM dups")
_put(
    "limit_per_group", BALANCE_BARS, CLEAN, ANOMALIES, FOUND.format(sigma=5.0),
    """SELECT instrument, rank, dt, kind, greatest(0, total - 50) AS more FROM (
      SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY kr, dt) AS rank, count(*) OVER (PARTITION BY instrument) AS total FROM found)
    WHERE rank <= 50""",
)
_put(
    "nth_sample", *HELD, EQUITY,
    """SELECT 'priority' AS panel, dt, round(equity, 6) + 0.0 AS equity FROM (
      SELECT *, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS n FROM eq) WHERE i % greatest(1, n // 20) = 0""",
)
_put(
    "best_trial", study(), TRIALS, COUNTED,
    "SELECT round(sharpe, 6) + 0.0 AS sharpe, panel, lookback FROM counted ORDER BY counted.sharpe DESC LIMIT 1",
)
_put("date_difference", PRIORITY, CAL, FRAME, "SELECT instrument, dt FROM frame WHERE close IS NULL")
_put(
    "concat_rows",
    """SELECT instrument, count(*) AS n, round(sum(close), 6) + 0.0 AS total FROM (
      SELECT o_orderpriority AS instrument, o_totalprice AS close FROM orders
      UNION ALL SELECT c_mktsegment, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""",
)

# --- windows ----------------------------------------------------------------------------------------------
_OWNW = "WINDOW w AS (PARTITION BY instrument ORDER BY dt)"
_put("lag_one", PRIORITY, SHARE_W, f"SELECT instrument, dt, round(coalesce(lag(w) OVER w, 0), 6) + 0.0 AS held FROM wts {_OWNW}")
_put(
    "ffill", BALANCE_BARS, CLEAN,
    """SELECT instrument, dt, round(last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) OVER
      (PARTITION BY instrument ORDER BY dt ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS close FROM bars""",
)
_put("gap_safe_returns", PRIORITY, *FRAMED, final("instrument dt ret*", "rets"))
_put("own_calendar_returns", BRAND, OWN, final("instrument dt own_ret*", "own"))
_put(
    "rolling_vol", PRIORITY, CAL, FRAME, OWN, own_vol(),
    """SELECT f.instrument, f.dt, round(last_value(v.vol IGNORE NULLS) OVER (PARTITION BY f.instrument ORDER BY f.dt ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS vol
    FROM frame f LEFT JOIN ownvol v ON v.instrument = f.instrument AND v.dt = f.dt""",
)
_put("exante_scalar", *momentum(PRIORITY), final("dt port_ret* port_vol* scalar*", "scalars"))
_put("turnover", PRIORITY, SHARE_W, f"SELECT instrument, dt, round(abs(w - coalesce(lag(w) OVER w, 0)), 6) + 0.0 AS turnover FROM wts {_OWNW}")
_put("equity_curve", *HELD, EQUITY, final("dt equity*", "eq"))
_put("drawdown", *HELD, EQUITY, DD, final("dt drawdown*", "dd"))
_put("additive_pnl", STEPS, "SELECT user_id, day, round(r, 9) + 0.0 AS r, round(pnl, 9) + 0.0 AS pnl FROM steps")
_put("log_return", BALANCE_BARS, CLEAN, ANOMALIES, final("instrument dt log_ret*", "logs"))
_put("open_gap", OHLC, OPEN_GAPS, final("instrument dt open_gap*", "gaps"))
_put("lead_one", PRIORITY, *FRAMED, f"SELECT instrument, dt, CAST(coalesce(sign(lead(ret) OVER w), 0) AS DOUBLE) + 0.0 AS w FROM rets {_OWNW}")
_put(
    "sq_autocorr", *HELD,
    "sq AS (SELECT dt, ret * ret - (SELECT avg(ret * ret) FROM series) AS s FROM series)",
    """SELECT 'priority' AS panel, round(sum(s * b) / sum(s * s), 6) + 0.0 AS acf FROM (SELECT s, lag(s) OVER (ORDER BY dt) AS b FROM sq)""",
)
_put("weight_change", PRIORITY, SHARE_W, f"SELECT instrument, dt, round(abs(w - lag(w) OVER w), 6) + 0.0 AS change FROM wts {_OWNW}")

# --- aggregates ---------------------------------------------------------------------------------------------
_put(
    "anomalous_return", BALANCE_BARS, CLEAN, ANOMALIES,
    "SELECT instrument, dt, 'anomalous_return' AS kind, printf('z=%.1f', z) AS detail FROM zs WHERE abs(z) > 3",
)
_put("session_gap", EVENT_OHLC, OPEN_GAPS, "SELECT instrument, dt, 'session_gap' AS kind, '' AS detail FROM gapz WHERE abs(z) > 2.5")
_put("nonpositive_price", BALANCE_BARS, CLEAN, "SELECT instrument, dt, 'nonpositive_price' AS kind, '' AS detail FROM bars WHERE close <= 0 OR close IS NULL")
_put(
    "calendar_gap", ORDER_BARS, CLEAN, MISSING,
    "SELECT instrument, CAST(NULL AS DATE) AS dt, 'calendar_gap' AS kind, count(*) || ' weekdays' AS detail FROM missing GROUP BY 1",
)
_put(
    "duplicate_dates", BALANCE_BARS, DUPLICATES,
    "SELECT instrument, CAST(NULL AS DATE) AS dt, 'duplicate_dates' AS kind, '' AS detail FROM dups WHERE has_duplicates",
)
_put(
    "quality_summary", BALANCE_BARS, CLEAN, ANOMALIES, MISSING, DUPLICATES, FOUND.format(sigma=5.0),
    """SELECT b.instrument, count(*) AS n_obs, min(b.dt) AS start, max(b.dt) AS "end",
      (SELECT count(*) FROM missing m WHERE m.instrument = b.instrument) AS missing_days,
      (SELECT count(*) FROM found f WHERE f.instrument = b.instrument AND kr = 1) AS nonpositive_price,
      (SELECT count(*) FROM found f WHERE f.instrument = b.instrument AND kr = 2) AS anomalous_return,
      CAST(0 AS BIGINT) AS session_gap,
      CAST((SELECT count(*) FROM missing m WHERE m.instrument = b.instrument) > 0 AS BIGINT) AS calendar_gap,
      CAST((SELECT bool_or(has_duplicates) FROM dups d WHERE d.instrument = b.instrument) AS BIGINT) AS duplicate_dates
    FROM bars b GROUP BY b.instrument""",
)
ORACLE["quality_merge"] = ORACLE["quality_summary"]
_put(
    "counts_by_kind", EVENT_BARS, DUPLICATES, EVENT_OHLC, ANOMALIES, OPEN_GAPS, MISSING,
    """SELECT instrument, kind, count(*) AS n FROM (
      SELECT instrument, 'nonpositive_price' AS kind FROM bars WHERE close <= 0 OR close IS NULL
      UNION ALL SELECT instrument, 'anomalous_return' FROM zs WHERE abs(z) > 2.5
      UNION ALL SELECT instrument, 'session_gap' FROM gapz WHERE abs(z) > 2.5
      UNION ALL SELECT DISTINCT instrument, 'calendar_gap' FROM missing
      UNION ALL SELECT instrument, 'duplicate_dates' FROM dups WHERE has_duplicates) GROUP BY 1, 2""",
)
_LS = (BRAND, *FRAMED, LAST_SIGN_W, "gx AS (SELECT dt, sum(abs(w)) AS gross FROM wts GROUP BY dt)")
_put("gross_exposure", *_LS, final("dt gross*", "gx"))
_put("exposure_violations", *_LS, final("dt gross*", "gx", "gx.gross > 4 + 1e-9"))
_put("validate_weights", *momentum(PRIORITY), "SELECT dt FROM wts GROUP BY dt HAVING sum(abs(w)) > 4 + 1e-9")
_put(
    "weight_violations", *momentum(PRIORITY), "gx AS (SELECT dt, sum(abs(w)) AS gross FROM wts GROUP BY dt)",
    "SELECT dt, round(gross, 6) + 0.0 AS gross, true AS raised FROM gx WHERE gross > 0.25 + 1e-9",
)
_put("cross_section_normalise", *_LS, "SELECT instrument, dt, round(coalesce(w / nullif(gross, 0), 0), 6) + 0.0 AS w FROM wts JOIN gx USING (dt)")
_put("gross_cap", *_LS, "SELECT instrument, dt, round(w * least(1, 4 / nullif(gross, 0)), 6) + 0.0 AS w FROM wts JOIN gx USING (dt)")
_SHARES = backtest_of(PRIORITY, SHARE_W, COSTS)
_put("portfolio_return", *_SHARES, final("dt gross*", "daily"))
_put("turnover_cost", *_SHARES, "SELECT dt, round(turnover, 6) + 0.0 AS turnover, round(turnover_cost * 1e4, 6) + 0.0 AS cost_bp FROM daily")
_put("swap_cost", *_SHARES, "SELECT dt, round(held, 6) + 0.0 AS held, round(swap_cost * 1e4, 6) + 0.0 AS cost_bp FROM daily")
_put("backtest", *backtest_of(BRAND, LAST_SIGN_W), "SELECT dt, round(ret * 1e4, 6) + 0.0 AS ret_bp FROM series")
_OWNSERIES = (BRAND, OWN, "s AS (SELECT instrument, dt, own_ret AS ret FROM own)")
_put("bars_per_year", *_OWNSERIES, f"SELECT instrument, round({PER_YEAR}, 6) + 0.0 AS bars_per_year FROM s GROUP BY 1")
_put("sharpe", *_OWNSERIES, f"SELECT instrument, round({SHARPE}, 6) + 0.0 AS sharpe FROM s GROUP BY 1")
METRICS = f"""SELECT '{{panel}}' AS panel, count(ret) AS n_obs, round({SHARPE}, 6) + 0.0 AS sharpe,
  round(min(drawdown), 6) + 0.0 AS max_drawdown, round(arg_max(equity, dt) - 1, 6) + 0.0 AS total_return,
  round(avg(ret), 6) + 0.0 AS mean_daily, round(stddev_pop(ret), 6) + 0.0 AS std_daily,
  round(arg_max(equity, dt), 6) + 0.0 AS final_equity FROM dd"""
_put("metrics", *HELD, EQUITY, DD, METRICS.format(panel="priority"))
_put(
    "return_histogram", *HELD,
    "b AS (SELECT min(ret) AS lo, max(ret) AS hi FROM series)",
    "e AS (SELECT i AS bin, lo + i * ((hi - lo) / 10) AS low, CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 10) END AS high FROM b, range(10) r(i))",
    "c AS (SELECT least(floor((ret - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin, count(*) AS n FROM series, b GROUP BY 1)",
    """SELECT 'priority' AS panel, bin, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high,
      printf('[%+.4f, %+.4f)', low, high) AS label, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (bin)""",
)
_put(
    "annual_turnover", *_SHARES,
    """SELECT 'priority' AS panel, round((sum(turnover) - arg_min(turnover, dt)) / ((max(dt) - min(dt)) / 365.25), 6) + 0.0 AS annual_turnover FROM daily""",
)
_put(
    "live_start", *momentum(PRIORITY),
    "SELECT 'priority' AS panel, greatest(DATE '1996-01-01', min(dt) FILTER (abs(w) > 0)) AS start FROM wts",
)
_put(
    "subperiod_stats", *HELD,
    f"""SELECT 'priority' AS panel, CASE WHEN dt <= DATE '{SPLIT}' THEN 'early' ELSE 'late' END AS period,
      round({SHARPE}, 6) + 0.0 AS sharpe, round(product(1 + ret) - 1, 6) + 0.0 AS total_return FROM series GROUP BY 2""",
)
_put(
    "dd_over_vol", *HELD, EQUITY, DD,
    f"""SELECT 'priority' AS panel, round(min(drawdown), 6) + 0.0 AS max_drawdown, round(stddev_pop(ret) * sqrt({PER_YEAR}), 6) + 0.0 AS annual_vol,
      round(abs(min(drawdown)) / (stddev_pop(ret) * sqrt({PER_YEAR})), 6) + 0.0 AS dd_over_vol FROM dd""",
)
_put(
    "zero_cost_sharpe", study(),
    f"""SELECT panel, lookback, round(zero_cost_sharpe, 6) + 0.0 AS zero_cost_sharpe, round(annual_turnover, 6) + 0.0 AS annual_turnover FROM (
      SELECT panel, lookback, {SHARPE} AS zero_cost_sharpe,
        (sum(turnover) - arg_min(turnover, dt)) / ((max(dt) - min(dt)) / 365.25) AS annual_turnover
      FROM (SELECT *, gross AS ret FROM daily_all) GROUP BY 1, 2)""",
)
_put(
    "swap_sensitivity", study(), TRIALS,
    "SELECT panel, " + ", ".join(
        f"round(max(sharpe) FILTER (swap_bp = {s}), 6) + 0.0 AS sharpe_{str(s).replace('.', '_')}bp" for s in (0.0, 0.3, 1.0)
    ) + " FROM trials WHERE lookback = 12 GROUP BY 1",
)
_put("deflated_sharpe", study(), TRIALS, COUNTED, deflation("counted"), final("n_trials best* expected_max* deflated*", "deflated"))
def verdict_parts(success: float, falsifier: float) -> tuple[str, ...]:
    return (
        study(), TRIALS, COUNTED, deflation("counted"),
        f"""v AS (SELECT panel, sharpe, CASE WHEN sharpe >= {success} THEN 'viable' WHEN sharpe < {falsifier} THEN 'dead' ELSE 'marginal' END AS verdict
      FROM counted WHERE lookback = 12)""",
        """g AS (SELECT CASE WHEN bool_or(verdict = 'viable') THEN 'viable' WHEN bool_and(verdict = 'dead') THEN 'dead' ELSE 'marginal' END AS global_verdict,
      bool_or(verdict = 'marginal') AS any_marginal,
      arg_min(verdict, panel) = 'viable' AND arg_max(verdict, panel) = 'dead' AS degraded FROM v)""",
        f"""SELECT panel, round(sharpe, 6) + 0.0 AS sharpe, verdict, global_verdict, degraded,
      CAST(CASE WHEN any_marginal THEN n_trials ELSE n_trials / 2 END AS BIGINT) AS attempts,
      round(CASE WHEN any_marginal THEN deflated END, 6) + 0.0 AS deflated,
      CASE WHEN any_marginal THEN deflated > {success} END AS promote FROM v, g, deflated""",
    )


# Success and falsifier of the study, and three pairs of limits that the ratios fall between.
BARS = ((-0.3, -0.4), (-0.2, -0.4), (-0.9, -1.0))
_put("verdict", *verdict_parts(0.4, 0.2))
_put(
    "verdict_bars",
    " UNION ALL ".join(f"SELECT {i} AS bar, * FROM ({with_(*verdict_parts(s, f))})" for i, (s, f) in enumerate(BARS)),
)
_put(
    "reference_sharpe_check", BRAND,
    # Alone in its panel an instrument's frame is its own calendar.
    OWN,
    "s AS (SELECT instrument AS panel, dt, coalesce(own_ret, 0) AS ret FROM own)",
    f"q AS (SELECT panel, {SHARPE} AS sharpe FROM s GROUP BY 1)",
    "SELECT panel, round(sharpe, 6) + 0.0 AS sharpe, abs(q.sharpe - 5.0) <= 0.5 AS within FROM q",
)

# --- signals --------------------------------------------------------------------------------------------------
_put("buy_and_hold", PRIORITY, CAL, FRAME, "SELECT instrument, dt, round(0.9::DOUBLE / (SELECT count(DISTINCT instrument) FROM prices), 6) + 0.0 AS w FROM frame")
_put("tsmom", *momentum(PRIORITY), final("instrument dt w*", "wts"))
_put("tsmom_fixed_year", *momentum(BRAND, 6, "252.0"), final("instrument dt w*", "wts", "wts.w <> 0"))
_put("tsmom_backtest", *momentum(BRAND), NO_COSTS, DENSE_W, DAILY, NET, EQUITY, DD, METRICS.format(panel="brand"))
_put(
    "lookahead_guard", PRIORITY, *FRAMED,
    f"sg AS (SELECT instrument, dt, ret, coalesce(sign(lead(ret) OVER w), 0) AS cheat, coalesce(sign(lag(ret) OVER w), 0) AS honest FROM rets {_OWNW})",
    f"sh AS (SELECT dt, ret, coalesce(lag(cheat) OVER w, 0) AS cheat, coalesce(lag(honest) OVER w, 0) AS honest FROM sg {_OWNW})",
    "sp AS (SELECT 'cheat' AS signal, dt, sum(cheat * ret) AS ret FROM sh GROUP BY dt UNION ALL SELECT 'honest', dt, sum(honest * ret) FROM sh GROUP BY dt)",
    f"q AS (SELECT signal, {SHARPE} AS sharpe FROM sp GROUP BY 1)",
    "SELECT signal, round(sharpe, 6) + 0.0 AS sharpe, q.sharpe > 5 AS caught FROM q",
)

_put(
    "signal_contract", PRIORITY, *FRAMED,
    """cuts AS (
  SELECT CAST(k AS INTEGER) AS cut, dt AS last_dt FROM (
    SELECT k, n // 2 + ('0x' || substr(md5(concat_ws('|', 12345, 'priority', k)), 1, 8))::BIGINT % (n - n // 2 - 1) AS pos
    FROM range(3) r(k), (SELECT count(*) AS n FROM cal)) JOIN cal USING (pos))""",
    f"sg AS (SELECT instrument, dt, coalesce(sign(lead(ret) OVER w), 0) AS cheat FROM rets {_OWNW})",
    """SELECT signal, cut, last_dt, count(*) AS n_cells, count(*) FILTER (signal = 'cheat' AND dt = last_dt AND cheat <> 0) AS n_changed,
      min(dt) FILTER (signal = 'cheat' AND dt = last_dt AND cheat <> 0) AS first_changed, CAST(0 AS BIGINT) AS n_strays
    FROM sg JOIN cuts ON dt <= last_dt, (VALUES ('cheat'), ('honest')) v(signal) GROUP BY ALL""",
)

# --- resampling -------------------------------------------------------------------------------------------------
_put(
    "block_bootstrap", *HELD, resampled(10_000, 756),
    """SELECT CAST(path AS INTEGER) AS path, count(*) AS days, round(sum(r), 6) + 0.0 AS total,
      round(arg_max(r, day), 6) + 0.0 AS last, round(sum(r * day), 6) + 0.0 AS weighted FROM walks WHERE phase = 1 GROUP BY path""",
)
_put("first_passage", STEPS, f"SELECT user_id, outcome, day FROM ({passage(0.10)})")
_put(
    "passage_batches",
    """steps AS (
  SELECT user_id, (value - 50) / 1999.0 AS r, row_number() OVER w AS day, sum((value - 50) / 1999.0) OVER w AS pnl
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""",
    f"SELECT user_id, outcome, day FROM ({passage(0.10)})",
)
_put(
    "phase_stats", STEPS, f"o AS ({passage(0.10)})",
    """SELECT round(count(*) FILTER (outcome = 'PASSED') / count(*), 6) + 0.0 AS p_pass, round(count(*) FILTER (outcome = 'FAILED') / count(*), 6) + 0.0 AS p_fail,
      round(count(*) FILTER (outcome = 'UNRESOLVED') / count(*), 6) + 0.0 AS p_unresolved,
      round(avg(day) FILTER (outcome <> 'UNRESOLVED'), 6) + 0.0 AS mean_absorb_day,
      round(coalesce(count(*) FILTER (outcome = 'PASSED') / nullif(count(*) FILTER (outcome <> 'UNRESOLVED'), 0), 0), 6) + 0.0 AS p_cond FROM o""",
)
_put(
    "funded_survival", STEPS,
    "lv AS (SELECT *, (day - 1) // 21 AS cycle, sum(r) OVER (PARTITION BY user_id, (day - 1) // 21 ORDER BY day) AS level FROM steps)",
    f"cy AS (SELECT user_id, cycle, count(*) AS days, bool_and(r > -0.05 AND level > -0.10) AS survived FROM lv GROUP BY 1, 2)",
    "SELECT round(count(*) FILTER (survived) / count(*), 6) + 0.0 AS p_survive FROM cy WHERE days = 21",
)

# --- turn of month ------------------------------------------------------------------------------------------------
_put("tom_flag", BRAND, tom(), "SELECT instrument, dt, tom FROM flags")
_put(
    "tom_signal", *tom_series(),
    "SELECT instrument, dt, round(w, 6) + 0.0 AS w, over AS capped FROM capped WHERE capped.w <> 0",
)
_put("mean_contrast", PRIORITY, OWN, tom(), contrast(1000), final("instrument contrast_bp* se_bp* ci_low_bp* ci_high_bp*", "contrast"))
_FRAMED_VOL = (PRIORITY, *FRAMED, OWN, own_vol())
_put("null_benchmark", *_FRAMED_VOL, *random_portfolios(1000), final("resample sharpe*", "nulls"))
_PLACED = (
    *tom_series(), *random_portfolios(1000),
    f"seen AS (SELECT {SHARPE} AS sharpe, (max(dt) - min(dt)) / 365.25 AS years FROM series)",
    """placed AS (SELECT 'priority' AS panel, max(s.sharpe) AS sharpe, avg(n.sharpe) AS null_mean, quantile_cont(n.sharpe, 0.95) AS null_p95,
      count(*) FILTER (n.sharpe >= s.sharpe) / count(*) AS p_value FROM nulls n, seen s)""",
)
_put("null_p_value", *_PLACED, final("panel sharpe* null_mean* null_p95* p_value*", "placed"))
_put(
    "sharpe_ci", *HELD,
    f"q AS (SELECT 'priority' AS panel, {SHARPE} AS sharpe, (max(dt) - min(dt)) / 365.25 AS years FROM series)",
    "c AS (SELECT *, sqrt((1 + sharpe * sharpe / 2) / years) AS se FROM q)",
    "d AS (SELECT *, sharpe - 1.96 * se AS ci_low, sharpe + 1.96 * se AS ci_high FROM c)",
    "e AS (SELECT *, CASE WHEN ci_low < 0.2 AND ci_high > 0.4 THEN 'underpowered' ELSE 'resolved' END AS status FROM d)",
    final("panel sharpe* years* se* ci_low* ci_high* status", "e"),
)
_put(
    "window_variant",
    "three AS (SELECT * FROM (" + with_(*tom_series(3), "SELECT * FROM series") + "))",
    "four AS (SELECT * FROM (" + with_(*tom_series(4), "SELECT * FROM series") + "))",
    f"counted AS (SELECT 'priority' AS panel, {SHARPE} AS sharpe FROM three UNION ALL SELECT 'priority', {SHARPE} FROM four)",
    deflation("counted", "panel"),
    "drawn AS (SELECT * FROM (" + with_(*_FRAMED_VOL, *random_portfolios(1000, 5), "SELECT * FROM nulls") + "))",
    "bar AS (SELECT quantile_cont(sharpe, 0.95) AS null_p95 FROM drawn)",
    """SELECT panel, n_trials, round(best, 6) + 0.0 AS best, round(expected_max, 6) + 0.0 AS expected_max, round(deflated, 6) + 0.0 AS deflated,
      round(null_p95, 6) + 0.0 AS null_p95, deflated > null_p95 AS promote FROM deflated, bar""",
)
_put(
    "relative_verdict", *_PLACED, contrast(1000),
    """j AS (SELECT p.panel, p.sharpe, p.null_p95, p.sharpe + 1.96 * sqrt((1 + p.sharpe * p.sharpe / 2) / s.years) AS ci_high,
      p.sharpe - 1.96 * sqrt((1 + p.sharpe * p.sharpe / 2) / s.years) AS ci_low,
      (SELECT ci_low_bp FROM contrast WHERE instrument = 'ALL') AS contrast_low FROM placed p, seen s)""",
    """k AS (SELECT *, CASE WHEN ci_low < 0.2 AND ci_high > 0.4 THEN 'underpowered' WHEN sharpe > null_p95 AND contrast_low > 0 THEN 'viable' WHEN sharpe > null_p95 THEN 'parked'
      WHEN ci_high > null_p95 THEN 'underpowered' ELSE 'dead' END AS verdict FROM j)""",
    final("panel sharpe* null_p95* ci_high* contrast_low* verdict", "k"),
)
