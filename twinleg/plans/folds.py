"""Queries of the shared fold table: families, arms, placebos and random features, each beside its oracle SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from twinleg.operators import folds as D
from twinleg.plans.panel import BASE, panel, rounded
from twinleg.sources.tables import daily_bars, daily_fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HORIZONS, SEEDS = [5, 20], ("11", "22", "33")
ARMS = {"base": ["x"], "m5": ["x", "rv20", "dd60"], "m6": ["x", "fx_trend20"], "m5_m6": ["x", "rv20", "dd60", "fx_trend20"]}
FEATURES, SHRINKAGES, CAP = [2, 3], [1e-3, 1e-1, 1.0], 200
#: Features a training row, from far fewer to far more than the rows.
COMPLEXITIES = [0.1, 0.25, 0.5, 0.9, 1.1, 2.0, 5.0, 10.0]


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, f"WITH {BASE}{body}"


def _regime():
    return F.when(F.col("pair_id").isin("ASIA", "EUROPE"), "constrained").otherwise("fungible")


def _features(s, d):
    return D.family_features(daily_bars(s, d), daily_fx(s, d))


def _frame(s, d, families=("m5", "m6"), **how):
    return D.fold_frame(panel(s, d), HORIZONS, _features(s, d) if families else None, families, **how)


_FEATURES = """,
r AS (SELECT pair_id, date, close, ln(close) - lag(ln(close)) OVER (PARTITION BY pair_id ORDER BY date) AS r FROM bars WHERE leg = 'N'),
trend AS (SELECT date, fx / lag(fx, 20) OVER (ORDER BY date) - 1 AS fx_trend20 FROM fx),
family AS (
  SELECT pair_id, date, CASE WHEN count(r) OVER w20 >= 20 THEN stddev_samp(r) OVER w20 * sqrt(252) END AS rv20,
    CASE WHEN count(*) OVER w60 >= 60 THEN close / max(close) OVER w60 - 1 END AS dd60, fx_trend20
  FROM r LEFT JOIN trend USING (date)
  WINDOW w20 AS (PARTITION BY pair_id ORDER BY date ROWS 19 PRECEDING), w60 AS (PARTITION BY pair_id ORDER BY date ROWS 59 PRECEDING))"""


def _folded(target: str = "level", families: bool = True, seeds: tuple[str, ...] = (), cap: int = 10**9) -> str:
    y = "lead(pi, h) OVER v" if target == "level" else "ln(1 + lead(pi, h) OVER v) - ln(1 + pi)"
    names = "rv20, dd60, fx_trend20" if families else "1 AS none"
    held = "AND rv20 IS NOT NULL AND dd60 IS NOT NULL AND fx_trend20 IS NOT NULL" if families else ""
    dealt = "b.y" if seeds else "a.y"
    return f"""{_FEATURES if families else ''},
ahead AS (SELECT panel.pair_id, date, pi AS x, h, {y} AS y FROM panel, (SELECT unnest({HORIZONS}) AS h) WINDOW v AS (PARTITION BY pair_id, h ORDER BY date)),
whole AS (SELECT pair_id, date, x, h, y, {names}, seed FROM ahead {'LEFT JOIN family USING (pair_id, date)' if families else ''}, (SELECT unnest({list(seeds) or ['']}) AS seed) WHERE y IS NOT NULL {held}),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, h, seed ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY pair_id, h, seed) AS n,
    row_number() OVER (PARTITION BY pair_id, h, seed ORDER BY md5(seed || '|' || pair_id || '|' || strftime(date, '%Y-%m-%d'))) - 1 AS dealt FROM whole),
swapped AS (SELECT a.* EXCLUDE (y), {dealt} AS y FROM placed a JOIN placed b ON a.pair_id = b.pair_id AND a.h = b.h AND a.seed = b.seed AND a.rn = b.dealt WHERE a.n >= 60),
cut AS (SELECT *, n // 6 + CAST(floor(fold * (n - n // 6) / 5.0) AS BIGINT) AS lo, n // 6 + CAST(floor((fold + 1) * (n - n // 6) / 5.0) AS BIGINT) AS hi FROM swapped, range(5) AS f(fold)),
frame AS (
  SELECT *, {'x' if target == 'level' else '0'} AS level, CASE WHEN rn >= lo AND rn < hi THEN 'test' ELSE 'train' END AS role
  FROM cut WHERE lo - h >= 30 AND hi > lo AND (rn >= lo AND rn < hi OR rn < lo - h AND rn >= lo - h - {cap}))"""


def _elimination(name: str, source: str, columns: list[str], shrink: str, keys: str) -> str:
    """CTEs that solve the normal equations of ``columns`` (sums c_i_j and c_i_y of ``source``) by Gauss-Jordan steps; slopes b_i."""
    k, out = len(columns), []
    cross = lambda i, j: f"c_{columns[min(i, j)]}_{columns[max(i, j)]}"
    first = [f"{cross(i, j)}{f' + {shrink}' if i == j else ''} AS a{i}{j}" for i in range(k) for j in range(k)] + [f"c_{columns[i]}_y AS a{i}{k}" for i in range(k)]
    out.append(f"{name}0 AS (SELECT {keys}, {', '.join(first)} FROM {source})")
    for p in range(k):
        step = [f"a{i}{j} {f'/ a{p}{p}' if i == p else f'- a{i}{p} * a{p}{j} / a{p}{p}'} AS a{i}{j}" for i in range(k) for j in range(k + 1)]
        out.append(f"{name}{p + 1} AS (SELECT {keys}, {', '.join(step)} FROM {name}{p})")
    return ",\n" + ",\n".join(out)


def _arms(arms: dict[str, list[str]]) -> str:
    columns = list(dict.fromkeys(c for cs in arms.values() for c in cs))
    keys = "pair_id, h, seed, fold"
    sums = [f"covar_pop({c}, {d}) * count(*) AS c_{c}_{d}" for i, c in enumerate(columns) for d in columns[i:]] + [f"covar_pop({c}, y) * count(*) AS c_{c}_y" for c in columns]
    means = [f"avg({c}) AS m_{c}" for c in [*columns, "y"]]
    out = f",\nfits AS (SELECT {keys}, {', '.join(means + sums)} FROM frame WHERE role = 'train' GROUP BY ALL)"
    guesses = []
    for arm, cs in arms.items():
        out += _elimination(f"s_{arm}_", "fits", cs, "1e-4", keys)
        guess = " + ".join(["m_y", *(f"({c} - m_{c}) * a{i}{len(cs)}" for i, c in enumerate(cs))])
        guesses.append(f"SELECT {keys}, rn, y, level, '{arm}' AS arm, {guess} AS guess FROM frame JOIN fits USING ({keys}) JOIN s_{arm}_{len(cs)} USING ({keys}) WHERE role = 'test'")
    return out + ",\nguesses AS (" + " UNION ALL ".join(guesses) + ")"


def _scores(by: str) -> str:
    return f""",
sides AS (SELECT *, unnest([CASE WHEN pair_id IN ('ASIA', 'EUROPE') THEN 'constrained' ELSE 'fungible' END, 'pooled']) AS regime FROM guesses),
scores AS (
  SELECT {by}, regime, count(*) AS n, sqrt(avg((y - guess) ** 2)) AS rmse, 1 - sum((y - guess) ** 2) / nullif(var_pop(y) * count(*), 0) AS r2,
    avg(CASE WHEN y <> level THEN CAST(sign(y - level) = sign(guess - level) AS INT) END) AS hit_rate FROM sides GROUP BY ALL)"""


_DELTAS = """,
deltas AS (SELECT x.h, x.arm, x.regime, x.n, x.rmse - b.rmse AS d_rmse, x.r2 - b.r2 AS d_r2 FROM scores x JOIN scores b ON x.h = b.h AND x.regime = b.regime AND b.arm = 'base' AND x.arm <> 'base')"""

_add("fit05_family_features", lambda s, d: rounded(_features(s, d)),
     _FEATURES + " SELECT pair_id, date, round(rv20, 6) AS rv20, round(dd60, 6) AS dd60, round(fx_trend20, 6) AS fx_trend20 FROM family")

_REPORT = """ SELECT pair_id, CAST(h AS BIGINT) AS h, CAST(fold AS BIGINT) AS fold, role, count(*) AS n, min(date) AS first_date, max(date) AS last_date,
  round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM frame GROUP BY ALL"""


def _report(frame):
    out = frame.groupBy("pair_id", "h", "fold", "role")
    return rounded(out.agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")))


_add("fit01_fold_table", lambda s, d: _report(_frame(s, d)), _folded() + _REPORT)
_add("win17_training_cap", lambda s, d: _report(_frame(s, d, cap=CAP, target="change")), _folded("change", cap=CAP) + _REPORT)


def _arm_scores(s, d, target="level"):
    return D.fold_scores(D.ridge_arms(_frame(s, d, target=target), ARMS), _regime(), ["h", "arm"])


_SCORED = " SELECT CAST(h AS BIGINT) AS h, arm, regime, n, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(hit_rate, 6) AS hit_rate FROM scores"
_add("fit02_family_scores", lambda s, d: rounded(_arm_scores(s, d)), _folded() + _arms(ARMS) + _scores("h, arm") + _SCORED)
_add("fit02_change_scores", lambda s, d: rounded(_arm_scores(s, d, "change")), _folded("change") + _arms(ARMS) + _scores("h, arm") + _SCORED)
_add("join12_ablation", lambda s, d: rounded(D.ablation(_arm_scores(s, d))),
     _folded() + _arms(ARMS) + _scores("h, arm") + _DELTAS + " SELECT CAST(h AS BIGINT) AS h, arm, regime, n, round(d_rmse, 6) AS d_rmse, round(d_r2, 6) AS d_r2 FROM deltas")
_add("agg19_degenerate", lambda s, d: rounded(D.degenerate(D.ablation(_arm_scores(s, d)))),
     _folded() + _arms(ARMS) + _scores("h, arm") + _DELTAS + """,
t AS (SELECT arm, h, arg_max(d_r2, (n, regime)) FILTER (regime <> 'pooled') AS dominant, arg_min(d_r2, (n, regime)) FILTER (regime <> 'pooled') AS minority, max(d_r2) FILTER (regime = 'pooled') AS pooled FROM deltas GROUP BY ALL)
SELECT arm, CAST(h AS BIGINT) AS h, round(dominant, 6) AS dominant, round(minority, 6) AS minority, round(pooled, 6) AS pooled, minority > 0 AND dominant < 0 AND pooled < 0 AS degenerate FROM t""")


def _placebo(s, d):
    base = {"base": ["x"]}
    real = D.fold_scores(D.ridge_arms(_frame(s, d, (), target="change"), base), _regime(), ["h"])
    shuffled = D.fold_scores(D.ridge_arms(_frame(s, d, (), target="change", seeds=SEEDS), base), _regime(), ["h", "seed"])
    return rounded(D.against_placebo(real, shuffled))


def _placebo_sql() -> str:
    """Both passes in one statement: the shuffled one under names of its own."""
    real = _folded("change", False) + _arms({"base": ["x"]}) + _scores("h")
    other = _folded("change", False, SEEDS) + _arms({"base": ["x"]}) + _scores("h, seed")
    for name in ("ahead", "whole", "placed", "swapped", "cut", "frame", "fits", "s_base_0", "s_base_1", "guesses", "sides", "scores"):
        other = re.sub(rf"\b{name}\b", f"z_{name}", other)
    return real + other + """,
mean AS (SELECT h, regime, avg(r2) AS placebo_r2, avg(hit_rate) AS placebo_hit, count(*) AS seeds FROM z_scores GROUP BY ALL)
SELECT CAST(h AS BIGINT) AS h, regime, n, round(r2, 6) AS r2, round(hit_rate, 6) AS hit_rate, round(placebo_r2, 6) AS placebo_r2, round(placebo_hit, 6) AS placebo_hit, seeds,
  placebo_r2 > 0.02 OR abs(placebo_hit - 0.5) > 0.03 AS leak FROM scores JOIN mean USING (h, regime)"""


_add("join13_placebo", _placebo, _placebo_sql())


def _leaks(s, d):
    """FIT-04 over the fold table with every tenth test row planted among its own fold's training rows."""
    frame = _frame(s, d)
    return rounded(D.leakage(frame.unionByName(frame.where("role = 'test' and rn % 10 = 0").withColumn("role", F.lit("train")))))


_add("fit04_leakage", _leaks,
     _folded() + """, planted AS (SELECT pair_id, h, seed, fold, rn, role FROM frame UNION ALL SELECT pair_id, h, seed, fold, rn, 'train' FROM frame WHERE role = 'test' AND rn % 10 = 0),
o AS (SELECT pair_id, h, seed, fold, rn FROM planted GROUP BY ALL HAVING count(DISTINCT role) > 1),
e AS (SELECT pair_id, h, seed, fold, max(rn) FILTER (role = 'train') AS last, min(rn) FILTER (role = 'test') AS first FROM planted GROUP BY ALL)
SELECT pair_id, CAST(h AS BIGINT) AS h, seed, CAST(fold AS BIGINT) AS fold, count(*) AS n, 'overlap' AS rule FROM o GROUP BY ALL
UNION ALL SELECT pair_id, CAST(h AS BIGINT), seed, CAST(fold AS BIGINT), last - first + h + 1, 'embargo' FROM e WHERE last >= first - h""")


def _random(s, d, features, shrinkages):
    frame = D.fold_frame(panel(s, d), [20], target="change", cap=CAP)
    return rounded(D.fold_scores(D.random_features(frame, features, shrinkages), _regime(), ["h", "p", "shrinkage"]))


def _random_guesses(features: list[int] = FEATURES, shrinkages: list[float] = SHRINKAGES, seeds: tuple[str, ...] = ()) -> str:
    """The fold table of the random features and their guesses."""
    rounds = "lambda v, i: CASE WHEN i = 1 THEN v * (2 * v + 1) % 2147483648 ELSE xor(v, v >> 15) END"
    uniform = lambda n: f"((list_reduce([({n} * 40503 + salt) % 2147483648, 1, 2, 1, 2, 1, 2], {rounds}) + 0.5) / 2147483648)"
    out = _folded("change", False, seeds, cap=CAP).replace(str(HORIZONS), "[20]") + f""",
scaled AS (
  SELECT frame.*, (x - avg(x) FILTER (role = 'train') OVER k) / (stddev_pop(x) FILTER (role = 'train') OVER k + 1e-12) AS u, avg(y) FILTER (role = 'train') OVER k AS m_y,
    (20260729 + CAST('0x' || substr(md5(pair_id), 1, 6) AS BIGINT) + 7919 * fold + 104729 * p) % 2147483648 AS salt, p
  FROM frame, (SELECT unnest({features}) AS p) WINDOW k AS (PARTITION BY pair_id, h, seed, fold, p))"""
    guesses = []
    for p in features:
        z = [f"sqrt(2.0 / {p}) * cos(u * sqrt(-2 * ln({uniform(3 * j)})) * cos(2 * pi() * {uniform(3 * j + 1)}) + 2 * pi() * {uniform(3 * j + 2)}) AS z{j}" for j in range(p)]
        cross = [f"sum(z{i} * z{j}) AS c_z{i}_z{j}" for i in range(p) for j in range(i, p)] + [f"sum(z{i} * (y - m_y)) AS c_z{i}_y" for i in range(p)]
        keys = "pair_id, h, seed, fold, shrinkage"
        out += f""",
z{p} AS (SELECT *, {', '.join(z)} FROM scaled WHERE p = {p}),
t{p} AS (SELECT {keys}, {', '.join(cross)} FROM z{p}, (SELECT unnest({shrinkages})::DOUBLE AS shrinkage) WHERE role = 'train' GROUP BY ALL)"""
        out += _elimination(f"e{p}_", f"t{p}", [f"z{j}" for j in range(p)], "shrinkage", keys)
        guess = " + ".join(["m_y", *(f"z{j} * a{j}{p}" for j in range(p))])
        guesses.append(f"SELECT pair_id, h, seed, fold, rn, {p} AS p, shrinkage, y, level, {guess} AS guess FROM z{p} JOIN e{p}_{p} USING (pair_id, h, seed, fold) WHERE role = 'test'")
    return out + ",\nguesses AS (" + " UNION ALL ".join(guesses) + ")"


def _random_sql() -> str:
    return _random_guesses() + _scores("h, p, shrinkage") + " SELECT CAST(h AS BIGINT) AS h, CAST(p AS BIGINT) AS p, shrinkage, regime, n, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(hit_rate, 6) AS hit_rate FROM scores"


_add("fit03_random_features", lambda s, d: _random(s, d, FEATURES, SHRINKAGES), _random_sql())
#: No SQL: solving 200 rows by 2,000 features is no business of SQL; a test holds the dual against a primal ridge.
QUERIES["fit03_complexity_grid"] = lambda s, d: _random(s, d, [max(2, round(c * CAP)) for c in COMPLEXITIES], [1e-6, 1e-3, 1e-1, 1.0, 10.0])
