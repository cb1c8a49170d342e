"""Queries of pooled persistence over the panel and over the persistent walk, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import persistence as P
from twinleg.operators.risk import horizon_grid
from twinleg.plans.panel import BASE, panel, rounded
from twinleg.plans.trades import _HAC, _WALK, ORACLES as TRADES, _walk

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
GRID, SHOWN = horizon_grid(), [1, 5, 20]
_CLASS = "CASE WHEN pair_id IN ('ASIA', 'EUROPE') THEN 'constrained' ELSE 'fungible' END"


def _regime():
    return F.expr(_CLASS)


def _path(source: str, regime: str, pool: bool) -> str:
    """The whole path of ``source`` by ``regime``: rows ahead by a join, errors over padded places."""
    stacked = "SELECT regime, pair_id, rn, h, x, y FROM j" + (" UNION ALL SELECT 'POOLED', pair_id, rn, h, x, y FROM j" if pool else "")
    return f""", dm AS (SELECT pair_id, rn, {regime} AS regime, pi - avg(pi) OVER (PARTITION BY pair_id) AS x FROM {source}),
hz AS (SELECT unnest(list_concat(range(1, 21), range(25, 101, 5), range(110, 401, 10))) AS h),
j AS (SELECT a.regime, a.pair_id, a.rn, h, a.x, b.x AS y FROM dm a, hz, dm b WHERE a.pair_id = b.pair_id AND b.rn = a.rn + h), jj AS ({stacked}),
g AS (SELECT regime, h, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1e-4) AS rho FROM jj GROUP BY 1, 2 HAVING count(*) >= 20),
k AS (SELECT * FROM (SELECT *, min(n / h) OVER (PARTITION BY regime ORDER BY h) AS room FROM g) WHERE room >= 5),
u AS (SELECT regime, h, row_number() OVER (PARTITION BY regime, h ORDER BY pair_id, rn) AS pos, (x - mx) * (y - my - rho * (x - mx)) AS u, (y - my - rho * (x - mx)) ** 2 AS rs, (y - my) ** 2 AS ys FROM jj JOIN k USING (regime, h)),
pad AS (SELECT regime, h, pos, u FROM u UNION ALL SELECT regime, h, n + unnest(range(1, h + 1)), 0 FROM k),
rol AS (SELECT regime, h, sum(u) OVER (PARTITION BY regime, h ORDER BY pos RANGE BETWEEN h PRECEDING AND CURRENT ROW) AS s FROM pad), m AS (SELECT regime, h, sum(s * s) / (h + 1) AS meat FROM rol GROUP BY 1, 2),
e AS (SELECT regime, h, sum(rs) AS sse, sum(ys) AS sst FROM u GROUP BY 1, 2), np AS (SELECT regime, count(DISTINCT pair_id) AS pairs FROM dm GROUP BY 1 UNION ALL SELECT 'POOLED', count(DISTINCT pair_id) FROM dm),
pth AS (SELECT k.regime, k.h, pairs, n, rho, my - rho * mx AS alpha, 1 - sse / nullif(sst, 0) AS r2, sqrt(meat) / nullif(sxx, 0) AS se, n / k.h AS spans FROM k JOIN m USING (regime, h) JOIN e USING (regime, h) JOIN np USING (regime))"""


#: Half-lives of a path, as the query by pair has them.
_LIVES = TRADES["agg14_half_lives"].removeprefix(f"WITH RECURSIVE {BASE}{_HAC}")
_HL = f", hl AS (WITH path AS (SELECT regime AS pair_id, h, n, rho, se FROM pth){_LIVES})"


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, f"WITH {BASE}{body}"


_whole = lambda s, d: P.pooled_path(_walk(s, d), _regime(), GRID)
_add("agg12_pooled_errors", lambda s, d: rounded(P.pooled_path(panel(s, d), _regime(), GRID), 5),
     _path("panel", _CLASS, True) + """ SELECT regime, h, pairs, n, round(rho, 5) AS rho, CASE WHEN abs(alpha) < 5e-6 THEN 0 ELSE round(alpha, 5) END AS alpha, round(r2, 5) AS r2, round(se, 5) AS se, round(rho / nullif(se, 0), 5) AS t,
  round(spans, 5) AS spans, spans >= 12 AS identified FROM pth""")
_add("agg14_regime_half_lives", lambda s, d: rounded(P.regime_half_lives(_whole(s, d)), 4),
     _WALK + _path("walk", _CLASS, True) + _HL + " SELECT * EXCLUDE (pair_id), pair_id AS regime FROM hl")
_add("agg16_regime_metrics", lambda s, d: rounded(P.metrics(_whole(s, d), SHOWN), 4),
     _WALK + _path("walk", _CLASS, True) + _HL + """ SELECT regime, pairs, n, h, round(rho, 4) AS rho, round(rho / nullif(se, 0), 4) AS t, round(r2, 4) AS r2, round(spans, 4) AS spans, point AS half_life, lower AS half_life_lo, upper AS half_life_hi,
  unbounded_above, support, row_number() OVER (ORDER BY regime = 'POOLED', regime, h) AS place FROM pth JOIN hl ON hl.pair_id = regime WHERE h IN (1, 5, 20)""")
_add("agg51_class_gaps", lambda s, d: rounded(P.class_gaps(_walk(s, d), _regime(), "constrained", "fungible", GRID), 3),
     _WALK + _path("walk", "pair_id", False) + _HL + f""", lv AS (SELECT pair_id, {_CLASS} = 'constrained' AS slow, abs(avg(pi)) AS level FROM walk GROUP BY 1),
b AS (SELECT slow, level, CASE WHEN support <> 'sub_resolution' THEN point END AS life FROM lv LEFT JOIN hl USING (pair_id)),
q AS (SELECT count(*) FILTER (slow) AS slow_pairs, count(*) FILTER (NOT slow) AS fast_pairs, count(life) FILTER (slow) AS slow_lives, count(life) FILTER (NOT slow) AS fast_lives,
  min(level) FILTER (slow) / max(level) FILTER (NOT slow) AS level_gap, min(life) FILTER (slow) / max(life) FILTER (NOT slow) AS dynamics_gap FROM b)
SELECT * REPLACE (round(level_gap, 3) AS level_gap, round(dynamics_gap, 3) AS dynamics_gap), dynamics_gap > 2 * level_gap AS informative FROM q""")
