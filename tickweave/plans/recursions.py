"""SQL of queries that are recursions over a symbol's bars, or build on one: volatility, barriers scaled by it, pivots, smoothed stochastics, regressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tickweave.functions import kernels as K


def fold(start: str, step: str, state: str, source: str, name: str) -> str:
    """A recursion over the rows of ``source`` in order of rn: ``step`` may use b (the row) and e (the state). Makes the table ``name``."""
    return f", e_{name} AS (SELECT symbol, rn, {start} FROM {source} AS b WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, {step} FROM e_{name} AS e JOIN {source} AS b ON b.symbol = e.symbol AND b.rn = e.rn + 1), {name} AS MATERIALIZED (SELECT b.*, {state} FROM {source} AS b JOIN e_{name} AS e ON e.symbol = b.symbol AND e.rn = b.rn)"


def volatility(*spans: int) -> str:
    """The table vol, with a column vol<span> for each: the exponential deviation of returns against the last bar more than a day before."""
    back = "(PARTITION BY symbol ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND to_microseconds(86400000001) PRECEDING)"
    rows = f", back AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, close / last_value(close) OVER {back} - 1 AS ret FROM bars)"
    start, step, state = [], [], []
    for n in spans:
        keep = f"{1 - 2 / (n + 1)!r}e0"
        has, x = "CASE WHEN b.ret IS NULL THEN 0e0 ELSE 1e0 END", "coalesce(b.ret, 0e0)"
        for c, k, new in (("w", keep, has), ("v", f"{keep} * {keep}", has), ("s", keep, x), ("q", keep, f"{x} * {x}")):
            start.append(f"{new} AS {c}{n}")
            step.append(f"{k} * e.{c}{n} + {new} AS {c}{n}")
        w, free = f"e.w{n}", f"(e.w{n} * e.w{n} - e.v{n})"
        state.append(f"CASE WHEN {free} > 1e-14 * greatest({w} * {w}, 1e-300) THEN sqrt(greatest(e.q{n} / {w} - pow(e.s{n} / {w}, 2), 0e0) * {w} * {w} / {free}) ELSE 0.01e0 END AS vol{n}")
    return rows + fold(", ".join(start), ", ".join(step), ", ".join(state), "back", "vol")


def labels(source: str, days: int, target: str) -> str:
    """The table done of triple-barrier labels of ``source`` (symbol, ts, close), barriers over and under ``target`` (of the row l)."""
    return f""", ends AS (SELECT a.*, coalesce((SELECT min(b.ts) FROM {source} b WHERE b.symbol = a.symbol AND b.ts >= a.ts + INTERVAL {days} DAY), max(a.ts) OVER (PARTITION BY a.symbol)) AS vb FROM {source} a),
    hits AS (SELECT l.symbol, l.ts, any_value(l.close) AS price, any_value(l.vb) AS vb, min(CASE WHEN p.close / l.close - 1 < -{target} THEN p.ts END) AS sl, min(CASE WHEN p.close / l.close - 1 > {target} THEN p.ts END) AS pt
        FROM ends l JOIN {source} p ON p.symbol = l.symbol AND p.ts BETWEEN l.ts AND l.vb GROUP BY l.symbol, l.ts),
    hit AS (SELECT *, least(vb, coalesce(sl, vb), coalesce(pt, vb)) AS hit_date, sl IS NULL AND pt IS NULL AS timed FROM hits),
    done AS MATERIALIZED (SELECT h.symbol, h.ts, h.hit_date, CASE WHEN timed THEN 0e0 ELSE sign(b.close / price - 1) END AS bin, b.close / price - 1 AS returns FROM hit h JOIN {source} b ON b.symbol = h.symbol AND b.ts = h.hit_date)"""


def pivots(limit: str, source: str) -> str:
    """The table turned: rows of ``source`` (symbol, ts, rn, close) with flag (a directional change is recognised) and ext (the bar of its extreme)."""
    first = f", lim AS MATERIALIZED (SELECT *, {limit} AS lim, first_value(close) OVER (PARTITION BY symbol ORDER BY rn) AS c0 FROM {source})"
    way = ", way AS (SELECT symbol, coalesce(arg_min(close > c0, rn) FILTER (WHERE rn > 1 AND abs(close - c0) / abs(c0) >= lim), true) AS up0 FROM lim GROUP BY symbol), walk AS MATERIALIZED (SELECT lim.*, CASE WHEN up0 THEN 1e0 ELSE -1e0 END AS s0 FROM lim JOIN way USING (symbol))"
    on, turn = "e.s * (b.close - e.v) > 0", "e.s * (b.close - e.v) / abs(e.v) < -b.lim"
    step = f"CASE WHEN NOT ({on}) AND {turn} THEN -e.s ELSE e.s END AS s, CASE WHEN {on} OR {turn} THEN b.close ELSE e.v END AS v, CASE WHEN {on} OR {turn} THEN b.rn ELSE e.at END AS at, CASE WHEN NOT ({on}) AND {turn} THEN 1 ELSE 0 END AS flag, e.at AS ext"
    return first + way + fold("s0 AS s, close AS v, rn AS at, 1 AS flag, rn AS ext", step, "e.flag, e.ext", "walk", "turned")


def _list(x: np.ndarray) -> str:
    return "[" + ", ".join(f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in map(float, x)) + "]"


def recursive_sql(flag: str, hourly: str, supplier: str, ranged: str, labelled: str, moments: str, rounded: Callable, squash: Callable, mean: Callable) -> dict[str, str]:
    """SQL by query; the arguments are the tables and expressions that other queries use too."""
    value = lambda x, name="value": f" SELECT symbol, ts, {rounded(x)} AS {name}"
    r = "WITH RECURSIVE "
    expansion = "coalesce(vol10 / nullif(vol50, 0) > 1.2e0, false)"
    out = f"hit_date, {rounded('bin')} AS bin, {rounded('returns')} AS returns"
    w14 = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    raw = lambda x: f"CASE WHEN rn > 14 THEN 100e0 * ({x} - min({x}) {w14}) / nullif(max({x}) {w14} - min({x}) {w14}, 0) END AS raw"
    once = "(0.33333e0 * b.raw + 0.66667e0 * e.o1)"
    smooth = fold("50e0 AS o1, 50e0 AS o2", f"CASE WHEN b.raw IS NULL THEN 50e0 WHEN b.rn = 15 THEN b.raw WHEN b.rn = 16 THEN {once} ELSE 0.33333e0 * {once} + 0.66667e0 * e.o2 END AS o1, e.o1 AS o2", "e.o1 AS o", "st", "smoothed")
    wilder = lambda n, x: f"CASE WHEN b.rn <= 14 THEN e.{n} ELSE (13 * e.{n} + greatest({x}, 0e0)) / 14 END AS {n}"
    eps = "2.220446049250313e-16"
    seed = ", seeded AS MATERIALIZED (SELECT *, " + ", ".join(f"sum(CASE WHEN rn BETWEEN 2 AND 14 THEN greatest({x}, 0e0) END) OVER (PARTITION BY symbol) / 13 + {eps} AS {n}0" for n, x in (("u", "close - pc"), ("d", "pc - close"))) + " FROM tr)"
    rsi = seed + fold("u0 AS u, d0 AS d", f"{wilder('u', 'b.close - b.pc')}, {wilder('d', 'b.pc - b.close')}", "e.u, e.d", "seeded", "strength")
    rsi += ", rs AS MATERIALIZED (SELECT symbol, ts, rn, CASE WHEN rn <= 14 OR u + d = 0 THEN 0e0 ELSE (100 * u / (u + d) - 50) / 10 END AS x FROM strength)"
    window = lambda n: f"list(ln(close)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    unit, line = _list(K.unit_legendre(21, 1)), _list(K.legendre(14, 1))
    trend = f", l AS (SELECT symbol, ts, rn, {mean('tr', 63)} AS atr, {window(21)} AS x FROM tr), f AS (SELECT *, list_dot_product(x, {unit}) AS dot, list_avg(x) AS m FROM l WHERE len(x) = 21), g AS (SELECT *, list_sum(list_transform(list_zip(x, {unit}), lambda z: pow(z[1] - m - dot * z[2], 2))) AS rest, list_sum(list_transform(x, lambda z: pow(z - m, 2))) AS whole FROM f), h AS (SELECT l.symbol, l.ts, l.rn, g.dot * 2 / (l.atr * 20 + 1e-60) * greatest(1 - rest / (whole + 1e-60), 0e0) AS z FROM l LEFT JOIN g USING (symbol, ts))"
    deviation = f", l AS (SELECT symbol, ts, {window(14)} AS x FROM bars), f AS (SELECT *, list_dot_product(x, {line}) AS dot, list_avg(x) AS m FROM l WHERE len(x) = 14), g AS (SELECT *, list_transform(list_zip(x, {line}), lambda z: z[1] - dot * z[2] - m) AS rest FROM f), h AS (SELECT l.symbol, l.ts, rest[14] / sqrt(list_sum(list_transform(rest, lambda v: v * v)) / 14) AS z FROM l LEFT JOIN g USING (symbol, ts))"
    ff = "ff AS (SELECT 0 AS k, 1e0 AS w UNION ALL SELECT k + 1, -w * (0.7e0 - k) / (k + 1) FROM ff WHERE k < (SELECT max(n) FROM (SELECT count(*) AS n FROM bars GROUP BY symbol))), weights AS (SELECT list(w ORDER BY k) AS w FROM ff)"
    expanding = f", {ff}, l AS (SELECT symbol, ts, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS x, count(*) OVER (PARTITION BY symbol) AS n FROM bars), sh AS (SELECT n, k, sum(abs(f.w)) OVER (PARTITION BY n ORDER BY k DESC) / sum(abs(f.w)) OVER (PARTITION BY n) AS share FROM (SELECT DISTINCT n FROM l) JOIN ff f ON f.k < n), sk AS (SELECT n, count(*) FILTER (WHERE share > 0.01) AS skip FROM sh GROUP BY n)"
    known = " SELECT t.symbol, t.ts, x.ts AS extreme_ts FROM turned t JOIN turned x ON x.symbol = t.symbol AND x.rn = t.ext WHERE t.flag = 1"
    ohlc = "(open + high + low + close) / 4 * volume"
    so_far = "OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING)"
    inside = "OVER (PARTITION BY symbol, live ORDER BY rn ROWS UNBOUNDED PRECEDING)"
    anchored = f", seg AS (SELECT *, sum(flag) {so_far} - flag AS seg FROM turned), live AS (SELECT *, coalesce(max(CASE WHEN volume > 0 OR seg = 0 THEN seg END) {so_far}, 0) AS live FROM seg), vw AS (SELECT *, sum({ohlc}) {inside} / nullif(sum(volume) {inside}, 0) AS vwap FROM live)"
    ratio = lambda a, b: f"(({a}) / ({b}))"
    dagostino = (
        moments
        + f", d1 AS (SELECT *, skew * sqrt({ratio('(n + 1) * (n + 3)', '6 * (n - 2)')}) AS y, {ratio('3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)', '(n - 2) * (n + 5) * (n + 7) * (n + 9)')} AS beta, (kurt + 3 - 3 * (n - 1) / (n + 1)) / sqrt({ratio('24 * n * (n - 2) * (n - 3)', 'pow(n + 1, 2) * (n + 3) * (n + 5)')}) AS x,"
        f" {ratio('6 * (n * n - 5 * n + 2)', '(n + 7) * (n + 9)')} * sqrt({ratio('6 * (n + 3) * (n + 5)', 'n * (n - 2) * (n - 3)')}) AS root FROM k), d2 AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a FROM d1),"
        " d3 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM d2), d4 AS (SELECT *, z1 * z1 + z2 * z2 AS stat FROM d3)"
        f" SELECT symbol, n, {rounded('skew')} AS skew, {rounded('kurt')} AS excess_kurtosis, {rounded('stat')} AS statistic, {rounded('exp(-stat / 2)')} AS p_value, exp(-stat / 2) > 0.05 AS is_normal FROM d4"
    )
    return {
        "daily_volatility": r + flag + volatility(20) + value("vol20", "vol") + " FROM vol",
        "event_sampling": r + flag + volatility(50, 10) + f" SELECT symbol, ts, {expansion} AS event_flag FROM vol",
        "flag_share": r + flag + volatility(50, 10) + f" SELECT symbol, {rounded(f'avg(CAST({expansion} AS INTEGER))')} AS share FROM vol GROUP BY symbol",
        "triple_barrier_scaled": r + flag + volatility(10) + ", base AS MATERIALIZED (SELECT symbol, ts, close, vol10 AS target FROM vol WHERE rn > 2)" + labels("base", 2, "l.target") + f" SELECT symbol, ts, {out} FROM done",
        "add_labels": "WITH " + hourly + labels("bars", 2, "0.1e0") + f" SELECT b.symbol, b.ts, {rounded('b.close')} AS close, {out} FROM bars b LEFT JOIN done d ON d.symbol = b.symbol AND d.ts = b.ts",
        "dagostino": "WITH " + supplier + dagostino,
        "stochastic": r + flag + ranged + f", st AS MATERIALIZED (SELECT *, {raw('close')} FROM tr)" + smooth + value("o") + " FROM smoothed",
        "stochastic_rsi": r + flag + ranged + rsi + f", st AS MATERIALIZED (SELECT *, {raw('x')} FROM rs)" + smooth + value("o") + " FROM smoothed",
        "regression_trend": "WITH " + flag + ranged + trend + value(f"CASE WHEN rn <= 63 THEN 0e0 ELSE {squash('1.5e0 * z')} END") + " FROM h",
        "regression_trend_deviation": "WITH " + flag + deviation + value(squash("0.6e0 * z")) + " FROM h",
        "frac_diff_expanding": r + hourly + expanding + value("CASE WHEN len(x) > skip THEN list_dot_product(x, list_reverse(w[1:len(x)])) END") + " FROM l JOIN sk USING (n), weights",
        "pivots": r + flag + ranged + pivots("0.02e0", "tr") + known,
        "pivots_by_volatility": r + flag + ranged + f", pa AS MATERIALIZED (SELECT *, {mean('tr', 14)} AS atr FROM tr)" + pivots("coalesce(atr / abs(close), 0.01e0)", "pa") + known,
        "anchored_vwap": r + flag + ranged + f", pa AS MATERIALIZED (SELECT *, {mean('tr', 14)} AS atr FROM tr)" + pivots("0.02e0", "pa") + anchored + value("CASE WHEN live = 0 THEN 0e0 WHEN atr > 0 THEN coalesce(abs(close - vwap) / atr, 0e0) ELSE 0e0 END") + " FROM vw",
    }
