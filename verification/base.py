"""SQL twins of the stand-ins, and the register of checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def R(expression: str) -> str:
    """SQL twin of ``snap``."""
    return f"ROUND(({expression}) + 3e-10, 6)"


def _seasons(first: int, last: int) -> str:
    return f"""
    SELECT CAST(y AS INTEGER) AS year, season, CAST(so AS INTEGER) AS season_ord,
           make_date(CASE WHEN season = 'Winter' THEN y - 1 ELSE y END, fm, 1) AS st, make_date(y, lm, ld) AS en
    FROM range({first}, {last + 1}) t(y),
         (VALUES ('Winter', 1, 11, 1, 31), ('Spring', 2, 2, 4, 30), ('Premonsoon', 3, 5, 6, 30), ('Growing', 4, 7, 10, 31))
           s(season, so, fm, lm, ld)
    WHERE y > {first} OR season = 'Growing'"""


def _daily(variable: str, prefix: str, scale: str = "", keep: str = "") -> str:
    v = f"value{scale}"
    return f"""
    SELECT g.*, d.summer, d.winter, g.house || '_' || g.plot AS plot_id, s.year, s.season
    FROM (SELECT id, house, plot, depth, date, AVG({v}) AS {prefix}_mean, MIN({v}) AS {prefix}_min, MAX({v}) AS {prefix}_max
          FROM readings WHERE variable = '{variable}' GROUP BY ALL) g
    LEFT JOIN design d USING (house, plot)
    JOIN seasons_ev s ON g.date BETWEEN s.st AND s.en {keep}"""


def _irrigation(day: str, per_mm: str) -> str:
    return f"""
    SELECT {day} AS date,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'S1' WHEN '2-HIGH' THEN 'S2' WHEN '3-MEDIUM' THEN 'S3'
                WHEN '4-NOT SPECIFIED' THEN 'S4' WHEN '5-LOW' THEN 'W1' END AS treatment,
           CASE WHEN COUNT(*) % 2 = 0 THEN 0.0e0
                ELSE CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / {per_mm} END AS irrigation_mm
    FROM orders GROUP BY 1, 2"""


def _folded(day: str) -> str:
    return f"(DATE '2024-01-01' + CAST((CAST({day} AS DATE) - DATE '1970-01-01') % 30 AS INTEGER))"


_TREATMENTS = "(VALUES ('S1'), ('S2'), ('S3'), ('S4'), ('W1'), ('W2'), ('W3')) tr(treatment)"


def theta(h: str, a: str, n: str, r: str) -> str:
    return f"({r} + (0.44 - {r}) * pow(1 + pow({a} * {h}, {n}), 1.0e0 / {n} - 1.0))"


def suction(t: str, a: str, n: str, r: str) -> str:
    """Suction in MPa with the same guards as the library."""
    power = f"(ln((0.44 - {r}) / ({t} - {r})) * {n} / ({n} - 1.0))"
    value = (
        f"(CASE WHEN {power} < 40 THEN pow(exp({power}) - 1.0, 1.0e0 / {n}) / {a} * 98.0665 / 1.0e6 "
        f"WHEN {power} / {n} < 709 THEN exp({power} / {n}) / 1.0e10 / {a} * 98.0665 / 1.0e6 * 1.0e10 END)"
    )
    return (
        f"CASE WHEN {t} > {r} AND {t} <= 0.44 AND {n} > 1 AND {a} > 0 "
        f"THEN CASE WHEN {value} < 'Infinity'::DOUBLE THEN {value} END END"
    )


VPD = (
    "(1.0 - RH_{p} / 100.0) * ((1.0007 + 3.46e-8 * 101000.0) * 611.21 * exp(17.502 * {t} / (240.97 + {t}))) / 1000.0"
)


def _air_clean() -> str:
    t = "CASE WHEN T_{p} >= -10 THEN T_{p} END"
    parts = []
    for p in ("outside", "inside"):
        clean = f"({t.format(p=p)})"
        parts.append(f"{clean} AS T_{p}, RH_{p}, {VPD.format(p=p, t=clean)} AS D_{p}")
    return "SELECT dt, date, " + ", ".join(parts) + " FROM air_wide"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "readings": (
        (),
        """
    SELECT *, CASE WHEN variable = 'TS' THEN '' ELSE variable || '_' END
              || 'P' || plot || '_' || depth || '_H' || house AS id
    FROM (SELECT ts AS dt, CAST(ts AS DATE) AS date,
                 CASE event_type WHEN 'view' THEN 'VWC' WHEN 'click' THEN 'SWP' WHEN 'signup' THEN 'TS'
                      WHEN 'purchase' THEN 'T' WHEN 'error' THEN 'RH' END AS variable,
                 CAST(user_id % 5 + 1 AS INTEGER) AS house, CAST(user_id // 5 % 12 + 1 AS INTEGER) AS plot,
                 CAST(user_id // 60 % 3 + 1 AS INTEGER) AS depth,
                 CASE WHEN user_id % 2 = 1 THEN 'inside' ELSE 'outside' END AS location,
                 CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_type = 'view' THEN value / 1000
                      WHEN event_type = 'click' THEN -10 * value WHEN event_type = 'purchase' THEN value - 15
                      WHEN event_type = 'error' THEN value % 100 ELSE value END AS value
          FROM events)""",
    ),
    "design": (
        (),
        """
    SELECT house, plot, 'W' || (plot % 3 + 1) AS winter, 'S' || ((house * 7 + plot) % 4 + 1) AS summer
    FROM (SELECT CAST(i // 12 + 1 AS INTEGER) AS house, CAST(i % 12 + 1 AS INTEGER) AS plot FROM range(60) t(i))
    WHERE NOT (house = 5 AND plot = 12)""",
    ),
    "seasons_ev": ((), _seasons(2023, 2024)),
    "seasons_li": ((), _seasons(1994, 2002)),
    "ts_daily": (("readings", "design", "seasons_ev"), _daily("TS", "ts", keep="WHERE g.ts_mean IS NOT NULL")),
    "wc_daily": (("readings", "design", "seasons_ev"), _daily("VWC", "wc")),
    "wp_daily": (("readings", "design", "seasons_ev"), _daily("SWP", "wp", " / 1000")),
    "six_hourly": (
        ("readings",),
        """
    SELECT time_bucket(INTERVAL '6 hours', dt) AS dt, date, variable, house, plot, depth, AVG(value) AS value
    FROM readings WHERE variable IN ('VWC', 'SWP') GROUP BY 1, 2, 3, 4, 5, 6""",
    ),
    "soil_grid": (
        ("six_hourly",),
        """
    SELECT b.dt, b.date, v.variable, p.plot, d.depth, h.house, s.value
    FROM (SELECT DISTINCT dt, date FROM six_hourly) b, (VALUES ('VWC'), ('SWP')) v(variable),
         (SELECT CAST(i AS INTEGER) AS house FROM range(1, 6) t(i)) h,
         (SELECT CAST(i AS INTEGER) AS plot FROM range(1, 13) t(i)) p,
         (SELECT CAST(i AS INTEGER) AS depth FROM range(1, 4) t(i)) d
    LEFT JOIN six_hourly s ON s.dt = b.dt AND s.variable = v.variable AND s.house = h.house AND s.plot = p.plot
                          AND s.depth = d.depth""",
    ),
    "air_wide": (
        ("readings",),
        """
    SELECT time_bucket(INTERVAL '30 minutes', dt) AS dt, date,
           AVG(value) FILTER (WHERE variable = 'T' AND location = 'inside') AS T_inside,
           AVG(value) FILTER (WHERE variable = 'T' AND location = 'outside') AS T_outside,
           AVG(value) FILTER (WHERE variable = 'RH' AND location = 'inside') AS RH_inside,
           AVG(value) FILTER (WHERE variable = 'RH' AND location = 'outside') AS RH_outside
    FROM readings WHERE variable IN ('T', 'RH') GROUP BY 1, 2""",
    ),
    "air_clean": (("air_wide",), _air_clean()),
    "air_long": (
        ("air_clean",),
        " UNION ALL ".join(
            f"SELECT dt, date, '{v}' AS variable, '{p}' AS location, {v}_{p} AS value FROM air_clean"
            for v in ("T", "RH", "D")
            for p in ("outside", "inside")
        ),
    ),
    "air_daily": (
        ("air_long", "seasons_ev"),
        """
    SELECT g.*, CASE variable WHEN 'T' THEN 'T~(~degree~C)' WHEN 'RH' THEN 'RH~(''%'')' ELSE 'D~(kPa)' END AS var_label,
           CAST(CASE location WHEN 'outside' THEN 1 ELSE 2 END AS INTEGER) AS location_ord, s.year, s.season
    FROM (SELECT variable, location, date, AVG(value) AS mean, MIN(value) AS min, MAX(value) AS max
          FROM air_long GROUP BY 1, 2, 3) g JOIN seasons_ev s ON g.date BETWEEN s.st AND s.en""",
    ),
    "irrigation": ((), _irrigation("CAST(o_orderdate AS DATE)", "1.0e7")),
    "irrigation_jan": ((), _irrigation(_folded("o_orderdate"), "1.0e9")),
    "irrigation_wide": (
        ("irrigation",),
        "SELECT date, "
        + ", ".join(f"MAX(irrigation_mm) FILTER (WHERE treatment = '{t}') AS {t}" for t in ("S1", "S2", "S3", "S4", "W1"))
        + " FROM irrigation GROUP BY 1",
    ),
    "gauge": (
        (),
        """
    SELECT CAST(l_shipdate AS DATE) AS date, CAST(SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS DOUBLE) / 1000.0 AS inches
    FROM lineitem GROUP BY 1 UNION ALL SELECT CAST(MIN(l_shipdate) AS DATE), 0.0e0 FROM lineitem""",
    ),
    "rain": (
        ("gauge",),
        "SELECT date, inches * 25.4 AS ppt_mm FROM gauge WHERE date <= DATE '1998-06-30' AND inches <> 0",
    ),
    "rain_jan": (
        (),
        f"""
    SELECT {_folded("l_shipdate")} AS date, CAST(SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS DOUBLE) / 1.0e4 AS ppt_mm
    FROM lineitem GROUP BY 1""",
    ),
    "watering": (
        ("irrigation", "rain"),
        f"""
    SELECT date, treatment, irrigation_mm, ppt_mm FROM irrigation
    FULL JOIN (SELECT date, treatment, ppt_mm FROM rain, {_TREATMENTS}) r USING (date, treatment)""",
    ),
    "watering_jan": (
        ("irrigation_jan", "rain_jan"),
        f"""
    SELECT date, treatment, irrigation_mm, ppt_mm FROM irrigation_jan
    FULL JOIN (SELECT date, treatment, ppt_mm FROM rain_jan, {_TREATMENTS}) r USING (date, treatment)""",
    ),
    "line_days": (
        (),
        """
    SELECT g.*, CASE WHEN NOT (house = 5 AND plot = 12) THEN 'S' || ((house * 7 + plot) % 4 + 1) END AS summer,
           CASE WHEN NOT (house = 5 AND plot = 12) THEN 'W' || (plot % 3 + 1) END AS winter,
           house || '_' || plot AS plot_id,
           CAST(year(date) + CASE WHEN month(date) >= 11 THEN 1 ELSE 0 END AS INTEGER) AS year,
           CASE WHEN month(date) IN (11, 12, 1) THEN 'Winter' WHEN month(date) <= 4 THEN 'Spring'
                WHEN month(date) <= 6 THEN 'Premonsoon' ELSE 'Growing' END AS season
    FROM (SELECT house, plot, depth, date, 0.05 + AVG(q) / 200.0 AS wc_mean, 0.05 + MIN(q) / 200.0 AS wc_min,
                 0.05 + MAX(q) / 200.0 AS wc_max, -AVG(c) / 5.0e6 AS wp_mean, -MAX(c) / 5.0e6 AS wp_min, -MIN(c) / 5.0e6 AS wp_max
          FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey % 5 + 1 AS INTEGER) AS house,
                       CAST(l_partkey % 12 + 1 AS INTEGER) AS plot, CAST(l_linenumber % 3 + 1 AS INTEGER) AS depth,
                       l_quantity AS q,
                       CASE WHEN l_linestatus = 'F' THEN CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS DOUBLE) END AS c
                FROM lineitem) GROUP BY 1, 2, 3, 4) g""",
    ),
    "wc_days": (("line_days",), "SELECT * EXCLUDE (wp_mean, wp_min, wp_max) FROM line_days"),
    "wp_days": (
        ("line_days",),
        "SELECT * EXCLUDE (wc_mean, wc_min, wc_max) FROM line_days WHERE wp_mean IS NOT NULL",
    ),
    "paired": (
        ("wp_days", "wc_days"),
        """
    SELECT p.*, c.wc_mean, c.wc_min, c.wc_max FROM wp_days p
    LEFT JOIN wc_days c USING (house, plot, depth, date)""",
    ),
    "obs": (
        (),
        """
    SELECT CAST((date - DATE '1990-01-01') * 100 + depth * 10 + CASE summer WHEN 'S1' THEN 1 ELSE 4 END AS BIGINT) AS obs_id,
           date, depth, summer, summer AS grp, depth || '_' || summer AS trt, theta, wp_mean,
           -(wp_mean * 1.0e6 / 98.0665) AS h_cm
    FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_linenumber % 3 + 1 AS INTEGER) AS depth,
                 CASE WHEN l_returnflag = 'A' THEN 'S1' ELSE 'S4' END AS summer, 0.05 + AVG(l_quantity) / 200.0 AS theta,
                 -AVG(CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS DOUBLE)) / 5.0e6 AS wp_mean
          FROM lineitem GROUP BY 1, 2, 3)""",
    ),
    "draws": (
        (),
        """
    SELECT CAST(l_linenumber % 3 + 1 AS INTEGER) AS chain, l_suppkey AS iter, grp,
           0.01 + CAST(SUM(l_partkey) % 1900 AS DOUBLE) / 10000.0 AS alpha_cm,
           1.2 + CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) % 1500 AS DOUBLE) / 1000.0 AS n,
           0.01 + CAST(SUM(CAST(l_quantity AS BIGINT)) % 400 AS DOUBLE) / 10000.0 AS theta_r,
           0.005 + CAST(COUNT(*) % 50 AS DOUBLE) / 1000.0 AS sigma
    FROM (SELECT *, 'site' AS grp FROM lineitem
          UNION ALL SELECT *, CASE WHEN l_returnflag = 'A' THEN 'S1' ELSE 'S4' END FROM lineitem) GROUP BY 1, 2, 3""",
    ),
    "terms": (
        ("draws",),
        " UNION ALL ".join(
            f"SELECT chain, iter, grp, '{p}' AS parameter, {p} AS x FROM draws" for p in ("alpha_cm", "n", "theta_r")
        ),
    ),
    "swc_grid": ((), "SELECT CAST(i AS INTEGER) AS swc_idx, i / 10000.0e0 AS swc FROM range(200, 4400) t(i)"),
    "lookup_q": (
        ("draws", "swc_grid"),
        f"""
    SELECT swc_idx, swc, grp, COUNT(s) AS n_ok, quantile_cont(s, 0.5) AS q50, quantile_cont(s, 0.25) AS q25,
           quantile_cont(s, 0.75) AS q75
    FROM (SELECT swc_idx, swc, grp, {suction("swc", "alpha_cm", "n", "theta_r")} AS s FROM swc_grid, draws)
    GROUP BY 1, 2, 3""",
    ),
    "lookup": (
        ("lookup_q",),
        """
    SELECT q.swc_idx, q.swc, q.grp, q.n_ok, CASE WHEN t.n_ok >= 100 THEN -q.q50 END AS q50,
           CASE WHEN t.n_ok >= 100 THEN -q.q25 END AS q25, CASE WHEN t.n_ok >= 100 THEN -q.q75 END AS q75
    FROM lookup_q q JOIN lookup_q t ON t.swc_idx = q.swc_idx AND t.grp = 'site'""",
    ),
    "reps": (
        ("obs", "draws"),
        f"""
    SELECT *, mu + sigma * sqrt(-2.0 * ln((one + 1) / 2147483648.0e0)) * cos(2.0 * pi() * (one * 48271 % 2147483647 / 2147483647.0e0)) AS rep
    FROM (SELECT o.obs_id, o.grp, o.trt, o.theta, d.chain, d.iter, d.sigma,
                 {theta("o.h_cm", "d.alpha_cm", "d.n", "d.theta_r")} AS mu,
                 (o.obs_id * 48271 + (d.iter * 10 + d.chain) * 69621 + 11) % 2147483647 * 48271 % 2147483647 AS one
          FROM obs o JOIN draws d ON o.grp = d.grp)""",
    ),
}


# Costly tables that several others read.
MATERIALIZED = {"line_days", "draws", "reps", "lookup_q"}


def grid_index_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(GREATEST(200, LEAST(4399, CEIL(ROUND({x} * 10000.0 - 0.5, 6)))) AS INTEGER) END"


def sql(needs: tuple[str, ...], body: str) -> str:
    """A query over the named common tables and everything they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    held = {n: "MATERIALIZED " if n in MATERIALIZED else "" for n in order}
    return "WITH " + ", ".join(f"{n} AS {held[n]}({CTES[n][1]})" for n in order) + " " + body


def check(name: str, needs: tuple[str, ...] = (), body: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when given, its SQL twin."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if body is not None:
            ORACLES[name] = sql(needs, body)
        return query

    return register
