"""Queries of the strategy diagnostics, on real and on dealt targets, each beside its oracle SQL."""

from __future__ import annotations

from twinleg.operators import diagnostics as G
from twinleg.operators import folds as D
from twinleg.plans.folds import CAP, _arms, _random_guesses, _regime
from twinleg.plans.panel import BASE, panel, rounded
from twinleg.session import cut_lineage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
H, FEATURES, SHRINKAGE, SEEDS = 20, 3, 1.0, ("11", "22")


def _rows(s, d, seeds=()):
    frame = cut_lineage(D.fold_frame(panel(s, d), [H], target="change", cap=CAP, seeds=seeds))
    return G.paired(frame, D.ridge_arms(frame, {"base": ["x"]}), D.random_features(frame, [FEATURES], [SHRINKAGE]), _regime())


def _tracks(seeds=()) -> str:
    return f"WITH {BASE}" + _random_guesses([FEATURES], [SHRINKAGE], seeds).replace("guesses AS (", "rich AS (") + _arms({"base": ["x"]}) + """,
spread AS (SELECT pair_id, seed, fold, CASE WHEN stddev_samp(y) > 0 THEN stddev_samp(y) ELSE 1e-9 END AS sigma FROM frame WHERE role = 'train' GROUP BY ALL),
paired AS (
  SELECT CASE WHEN a.pair_id IN ('ASIA', 'EUROPE') THEN 'constrained' ELSE 'fungible' END AS regime, a.pair_id, a.seed, a.fold, a.rn, a.y, a.guess AS guess_a, b.guess AS guess_b, sigma
  FROM guesses a JOIN rich b USING (pair_id, seed, fold, rn) JOIN spread USING (pair_id, seed, fold))"""


_DIAGNOSTICS = """,
t AS (
  SELECT regime, seed, row_number() OVER (PARTITION BY regime, seed ORDER BY pair_id, fold, rn) - 1 AS pos, sign(guess_a) * y AS a, sign(guess_b) * y AS b, -y AS u, -y / sigma AS v, sign(guess_b) AS side, sigma
  FROM paired),
m AS (
  SELECT regime, seed, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(u) AS mu, avg(v) AS mv, stddev_samp(a) AS sa, stddev_samp(b) AS sb, stddev_samp(u) AS su, stddev_samp(v) AS sv,
    covar_pop(v, b) / nullif(var_pop(v), 0) AS load, corr(side, sigma) AS corr_side_sigma FROM t GROUP BY ALL),
c AS (
  SELECT t.*, a - ma AS ca, b - mb AS cb, b - load * v - (mb - load * mv) AS ce, b - load * v AS rest, side - lag(side) OVER (PARTITION BY regime, seed ORDER BY pos) AS flip FROM t JOIN m USING (regime, seed)),
cross_ AS (
  SELECT x.regime, x.seed, sum(w * x.ca * z.ca) AS a, sum(w * x.cb * z.cb) AS b, sum(w * x.ce * z.ce) AS e
  FROM (SELECT *, unnest(range(1, 20)) AS k, 2 * (1 - unnest(range(1, 20)) / 20.0) AS w FROM c) x JOIN c z ON x.regime = z.regime AND x.seed = z.seed AND z.pos = x.pos - x.k GROUP BY ALL),
s AS (
  SELECT regime, seed, sum(ca * ca) AS a, sum(cb * cb) AS b, sum(ce * ce) AS e, sum(abs(flip)) / (count(*) - 1) / 2 AS turnover, stddev_samp(rest) AS s_rest,
    count(*) FILTER (pos % 20 = 0) AS blocks, avg(rest) FILTER (pos % 20 = 0) AS m_apart, stddev_samp(rest) FILTER (pos % 20 = 0) AS s_apart FROM c GROUP BY ALL),
z AS (
  SELECT m.*, turnover, s_rest, blocks, s_apart, CASE WHEN s_rest <= 1e-12 * sb THEN 0 ELSE m_apart END AS m_apart, CASE WHEN s_rest <= 1e-12 * sb THEN 0 ELSE mb - load * mv END AS alpha, greatest((s.a + x.a) / n, 1e-18) AS la, greatest((s.b + x.b) / n, 1e-18) AS lb, greatest((s.e + x.e) / n, 1e-18) AS le
  FROM m JOIN s USING (regime, seed) JOIN cross_ x USING (regime, seed))
SELECT regime, seed, n, round(coalesce(ma / nullif(sa, 0), 0) * sqrt(12.6), 5) AS sharpe_a, round(coalesce(mb / nullif(sb, 0), 0) * sqrt(12.6), 5) AS sharpe_b, round(coalesce(mu / nullif(su, 0), 0) * sqrt(12.6), 5) AS sharpe_short,
  round(coalesce(mv / nullif(sv, 0), 0) * sqrt(12.6), 5) AS sharpe_vol_managed, round(alpha, 5) AS alpha, round(load, 5) AS load, round(coalesce(alpha / nullif(s_rest, 0), 0) * sqrt(n), 5) AS t_alpha_naive,
  round(alpha / sqrt(le / n), 5) AS t_alpha_hac, round(CASE WHEN blocks > 2 THEN coalesce(m_apart / nullif(s_apart, 0), 0) * sqrt(blocks) ELSE 0 END, 5) AS t_alpha_apart, blocks,
  round(ma / sqrt(la / n), 5) AS t_a_hac, round(mb / sqrt(lb / n), 5) AS t_b_hac, round(corr_side_sigma, 5) AS corr_side_sigma, round(turnover, 5) AS turnover FROM z"""
_SHARES = """,
k AS (SELECT *, abs(y) AS size FROM paired),
edges AS (SELECT regime, seed, list_distinct(quantile_cont(size, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edges FROM k GROUP BY ALL),
cut_ AS (SELECT k.*, greatest(len(list_filter(edges, lambda e: e < size)), 1) AS tenth FROM k JOIN edges USING (regime, seed)),
each AS (SELECT regime, seed, tenth, size, y, 'a' AS track, sign(guess_a) AS side FROM cut_ UNION ALL SELECT regime, seed, tenth, size, y, 'b', sign(guess_b) FROM cut_),
g AS (
  SELECT regime, seed, track, tenth, avg(size) AS mean_size, avg(CAST(side = sign(y) AS INT)) AS hit_rate, sum(side * y) AS gains, sum(abs(side * y)) AS gross, avg(side * y) AS mean_gain, count(*) AS n FROM each GROUP BY ALL)
SELECT regime, seed, track, CAST(tenth AS BIGINT) AS tenth, round(mean_size, 6) AS mean_size, round(hit_rate, 6) AS hit_rate, round(gains / nullif(sum(gross) OVER (PARTITION BY regime, seed, track), 0), 6) AS gain_share,
  round(mean_gain, 6) AS mean_gain, n FROM g"""
for _name, _seeds in (("", ()), ("_shuffled", SEEDS)):
    QUERIES[f"agg32_strategy_diagnostics{_name}"] = lambda s, d, k=_seeds: rounded(G.strategy_diagnostics(_rows(s, d, k), H), 5)
    ORACLES[f"agg32_strategy_diagnostics{_name}"] = _tracks(_seeds) + _DIAGNOSTICS
    QUERIES[f"agg33_magnitude_shares{_name}"] = lambda s, d, k=_seeds: rounded(G.magnitude_shares(_rows(s, d, k)))
    ORACLES[f"agg33_magnitude_shares{_name}"] = _tracks(_seeds) + _SHARES
