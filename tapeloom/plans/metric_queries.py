"""Queries over trades: metrics, robustness, baselines, exits, books, sweeps."""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.spec import Condition, Stop, Target
from tapeloom.operators import baselines, book, exits, metrics, ranking, robust, sweep
from tapeloom.operators import trades as tr
from tapeloom.plans import tables as t
from tapeloom.plans.bar_queries import _MERGED, _momentum, merged_events
from tapeloom.plans.registry import query, r, rounded
from tapeloom.plans.trade_queries import BASE, rich_bars
from tapeloom.plans.trade_sql import BASE as BASE_SQL
from tapeloom.plans.trade_sql import RICH, trades_sql
from tapeloom.runtime import stage, with_row
from tapeloom.sources.bars import benchmark_from_bars

KEY = ["strategy_id"]
CAND = ["candidate_id"]

GRID = [
    (f"c{i:02d}", stop, rr, hold)
    for i, (stop, rr, hold) in enumerate(product((0.05, 0.10, 0.15), (1.5, 2.5), (5, 10)), start=1)
]
GRID_SQL = (
    "(VALUES " + ", ".join(f"('{i}', {s}, {g}, {h})" for i, s, g, h in GRID) + ") c(candidate_id, stop_v, target_v, hold)"
)
CANDIDATES = [
    sweep.Candidate(
        i, replace(BASE, exit=replace(BASE.exit, stop=Stop("pct", s), target=Target("rr", g), max_holding_days=h))
    )
    for i, s, g, h in GRID
]

TAKEN = "WITH RECURSIVE " + trades_sql(base=RICH, tags="regime, sector") + ", tk AS (SELECT *, 'trend' AS strategy_id FROM taken)"
SWEPT = "WITH RECURSIVE " + trades_sql(base=RICH, tags="regime, sector", cand=GRID_SQL) + ", tk AS (SELECT * FROM taken)"


def taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(tr.trades(rich_bars(spark, sf_dir), BASE))


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(sweep.sweep_trades(rich_bars(spark, sf_dir), CANDIDATES))


def metrics_sql(keys: str, source: str = "tk", tag: str = "") -> str:
    """CTEs giving ``om{tag}``: all trade metrics per key."""
    return f"""
ag{tag} AS (SELECT {keys}, count(*) AS n, avg(CAST(return_pct > 0 AS INT)) AS wr, avg(return_pct) AS mean,
  avg(return_pct) FILTER (return_pct > 0) AS win, avg(return_pct) FILTER (return_pct <= 0) AS loss, median(return_pct) AS med,
  stddev_samp(return_pct) AS sd, avg(holding_days) FILTER (holding_days > 0) AS hold_avg FROM {source} GROUP BY {keys}),
pa{tag} AS (SELECT *, sum(ln(greatest(1 + return_pct, 1e-300))) OVER o AS lv, row_number() OVER o AS rn,
  count(*) FILTER (return_pct > 0) OVER o AS isl FROM {source} WINDOW o AS (PARTITION BY {keys} ORDER BY symbol, signal_idx ROWS UNBOUNDED PRECEDING)),
pb{tag} AS (SELECT *, greatest(0, max(lv) OVER o) AS pk FROM pa{tag} WINDOW o AS (PARTITION BY {keys} ORDER BY rn ROWS UNBOUNDED PRECEDING)),
pc{tag} AS (SELECT {keys}, 1 - exp(-max(pk - lv)) AS dd, exp(arg_max(lv, rn)) - 1 AS tot FROM pb{tag} GROUP BY {keys}),
st{tag} AS (SELECT {keys}, max(c) AS streak FROM (SELECT {keys}, isl, count(*) FILTER (return_pct <= 0) AS c FROM pa{tag} GROUP BY {keys}, isl) GROUP BY {keys}),
om{tag} AS (SELECT {keys}, round(wr, 4) AS win_rate, round(mean, 6) AS avg_return, round(coalesce(win, 0), 6) AS avg_win_return,
  round(coalesce(loss, 0), 6) AS avg_loss_return, round(med + 1e-12, 6) AS median_return,
  round(coalesce(coalesce(win, 0) / nullif(coalesce(abs(loss), 0.001), 0), 0), 4) AS profit_loss_ratio, round(dd, 4) AS max_drawdown,
  round(coalesce(mean / nullif(sd, 0) * sqrt(least(n, 250)), 0), 4) AS sharpe_ratio, n AS signal_count,
  round(coalesce(hold_avg, 0), 1) AS avg_holding_days, streak AS max_consecutive_loss, round(tot, 6) AS total_return
  FROM ag{tag} JOIN pc{tag} USING ({keys}) JOIN st{tag} USING ({keys}))"""


_REAL = [c for c in metrics.METRIC_COLUMNS if c not in ("signal_count", "max_consecutive_loss")]
METRIC_SELECT = ", ".join(r(c, c) for c in _REAL) + ", signal_count, CAST(max_consecutive_loss AS BIGINT) AS max_consecutive_loss"


@query("g01_g08_g10_g11_overall_metrics", f"{TAKEN}, {metrics_sql('strategy_id')} SELECT strategy_id, {METRIC_SELECT} FROM om")
def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.overall_metrics(taken(spark, sf_dir), KEY))


@query("g13_sector_metrics", f"{TAKEN}, {metrics_sql('sector')} SELECT 'trend' AS strategy_id, sector, {METRIC_SELECT} FROM om")
def sector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.by_sector(taken(spark, sf_dir), KEY))


@query(
    "g12_regime_metrics",
    f"""{TAKEN} SELECT strategy_id, regime, {r('round(avg(CAST(return_pct > 0 AS INT)), 4)', 'win_rate')},
    {r('round(avg(return_pct), 6)', 'avg_return')}, count(*) AS signal_count FROM tk WHERE regime IS NOT NULL GROUP BY ALL""",
)
def regime_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.by_regime(taken(spark, sf_dir), KEY))


@query("i05_sweep_metrics", f"{SWEPT}, {metrics_sql('candidate_id')} SELECT candidate_id, {METRIC_SELECT} FROM om")
def sweep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = swept(spark, sf_dir)
    return rounded(metrics.overall_metrics(got, CAND, sweep.roster(CANDIDATES, got)))


def splits_sql(keys: str, source: str = "tk") -> str:
    """CTEs ``nb`` (numbered by date), ``sg`` (split gaps and consistency)."""
    return f"""
nb AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY signal_date, symbol, signal_idx) AS rn, count(*) OVER (PARTITION BY {keys}) AS nn FROM {source}),
sp AS (SELECT {keys}, max(nn) AS nn,
  avg(CAST(return_pct > 0 AS INT)) FILTER (rn <= floor(nn * 0.6)) AS tr,
  avg(CAST(return_pct > 0 AS INT)) FILTER (rn > floor(nn * 0.6) AND rn <= floor(nn * 0.8)) AS va,
  avg(CAST(return_pct > 0 AS INT)) FILTER (rn > floor(nn * 0.8)) AS te FROM nb GROUP BY {keys}),
yc AS (SELECT {keys}, CASE WHEN count(*) < 2 THEN 0.5 WHEN avg(wr) = 0 THEN 0.0 ELSE greatest(0, least(1, 1 - stddev_samp(wr) / avg(wr))) END AS yc
  FROM (SELECT {keys}, year(signal_date) AS y, count(*) AS c, avg(CAST(return_pct > 0 AS INT)) AS wr FROM {source} GROUP BY {keys}, y) WHERE c >= 5 GROUP BY {keys}),
sg AS (SELECT {keys}, round(tr, 4) AS train_win_rate, round(va, 4) AS val_win_rate, round(te, 4) AS test_win_rate, round(abs(tr - va), 4) AS train_val_gap,
  round(abs(va - te), 4) AS val_test_gap, round(coalesce(yc, 0.5), 4) AS yearly_consistency, 0.0 AS param_sensitivity FROM sp LEFT JOIN yc USING ({keys}))"""


_GAPS = [
    "train_win_rate",
    "val_win_rate",
    "test_win_rate",
    "train_val_gap",
    "val_test_gap",
    "yearly_consistency",
    "param_sensitivity",
]
GAP_SELECT = ", ".join(r(c, c) for c in _GAPS)


@query("g14_g16_split_gaps", f"{SWEPT}, {splits_sql('candidate_id')} SELECT candidate_id, {GAP_SELECT}, (train_val_gap > 0.15 OR val_test_gap > 0.10) AS is_overfit FROM sg")
def split_gap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = robust.split_gaps(swept(spark, sf_dir), CAND)
    return rounded(got.withColumn("is_overfit", robust.is_overfit()))


_COMPLEX = BASE.complexity


def confidence_sql(complexity: float = _COMPLEX) -> str:
    return f"""round(least(1, greatest(0, (0.25 * least(1, win_rate / 0.7) + 0.15 * least(1, greatest(0, avg_return / 0.05)) + 0.15 * least(1, profit_loss_ratio / 2.5)
    + 0.15 * greatest(0, 1 - max_drawdown / 0.30) + 0.10 * least(1, greatest(0, sharpe_ratio / 2.0)) + 0.10 * yearly_consistency + 0.10 * 1.0
    - (CASE WHEN train_val_gap > 0.10 THEN 0.15 ELSE 0 END) - (CASE WHEN val_test_gap > 0.08 THEN 0.10 ELSE 0 END) - {complexity * 0.10})
    * CASE WHEN signal_count < 10 THEN 0.3 WHEN signal_count < 30 THEN greatest(0.5, signal_count / 30) ELSE 1 END)), 4)"""


EVALS = f"""{SWEPT}, {metrics_sql('candidate_id')}, {splits_sql('candidate_id')},
ev AS (SELECT om.*, sg.* EXCLUDE (candidate_id), {confidence_sql()} AS confidence_score FROM om JOIN sg USING (candidate_id))"""


def evaluations(got: DataFrame) -> DataFrame:
    return sweep.fast_report(got, sweep.roster(CANDIDATES, got)).drop("complexity", "changes")


@query("g24_g26_fast_report", f"{EVALS} SELECT candidate_id, {METRIC_SELECT}, {GAP_SELECT}, {r('confidence_score', 'confidence_score')} FROM ev")
def fast_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluations(swept(spark, sf_dir)))


WALK = """
wf0 AS (SELECT candidate_id, max(nn) AS n FROM nb GROUP BY candidate_id),
wf1 AS (SELECT *, greatest(5, CAST(floor(n * 0.7) AS BIGINT)) AS first FROM wf0),
wf2 AS (SELECT *, greatest(5, (n - first) // 3) AS size FROM wf1),
wf3 AS (SELECT candidate_id, f AS fold_num, first + (f - 1) * size AS te, least(n, first + f * size) AS xe FROM wf2, range(1, 4) t(f) WHERE first + (f - 1) * size + 5 <= n),
wf AS (SELECT wf3.candidate_id, fold_num, te AS train_signal_count, xe - te AS test_signal_count,
  avg(CAST(return_pct > 0 AS INT)) FILTER (rn <= te) AS a, avg(CAST(return_pct > 0 AS INT)) FILTER (rn > te AND rn <= xe) AS b
  FROM wf3 JOIN nb ON nb.candidate_id = wf3.candidate_id GROUP BY ALL)"""


@query(
    "g17_walk_forward",
    f"""{SWEPT}, {splits_sql('candidate_id')}, {WALK} SELECT candidate_id, CAST(fold_num AS INT) AS fold_num, train_signal_count, test_signal_count,
    {r('round(a, 4)', 'train_win_rate')}, {r('round(b, 4)', 'test_win_rate')}, {r('round(abs(a - b), 4)', 'gap')} FROM wf""",
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.walk_forward(swept(spark, sf_dir), CAND))


@query(
    "g18_walk_forward_summary",
    f"""{SWEPT}, {splits_sql('candidate_id')}, {WALK} SELECT candidate_id, count(*) AS effective_folds, {r('round(avg(round(abs(a - b), 4)), 4)', 'walk_forward_gap')},
    {r('round(avg(CAST(round(abs(a - b), 4) <= 0.10 AS INT)), 4)', 'walk_forward_pass_rate')} FROM wf GROUP BY candidate_id""",
)
def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.walk_forward_summary(robust.walk_forward(swept(spark, sf_dir), CAND), CAND))


_HOLDOUT = """
h0 AS (SELECT candidate_id, regime, count(*) AS n, count(*) FILTER (return_pct > 0) AS w FROM tk WHERE regime IS NOT NULL GROUP BY ALL),
h1 AS (SELECT *, sum(n) OVER p - n AS ni, sum(w) OVER p - w AS wi, count(*) OVER p AS k FROM h0 WINDOW p AS (PARTITION BY candidate_id)),
ho AS (SELECT candidate_id, regime, regime IN ('trending_up') AS preferred, CAST(ni AS BIGINT) AS in_sample_signal_count, n AS holdout_signal_count,
  round(wi / ni, 4) AS in_sample_win_rate, round(w / n, 4) AS holdout_win_rate, round(abs(wi / ni - w / n), 4) AS gap FROM h1 WHERE k >= 2 AND n >= 5 AND ni >= 5)"""


@query(
    "g19_regime_holdout",
    f"""{SWEPT}, {_HOLDOUT} SELECT candidate_id, regime, preferred, in_sample_signal_count, holdout_signal_count,
    {r('in_sample_win_rate', 'in_sample_win_rate')}, {r('holdout_win_rate', 'holdout_win_rate')}, {r('gap', 'gap')} FROM ho""",
)
def regime_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.regime_holdout(swept(spark, sf_dir), CAND, ("trending_up",)))


@query(
    "g19_regime_holdout_summary",
    f"""{SWEPT}, {_HOLDOUT} SELECT candidate_id, count(*) AS total_cases, {r('round(avg(CAST(gap <= 0.10 AS INT)), 4)', 'pass_rate')},
    {r('max(gap)', 'worst_gap')} FROM ho GROUP BY candidate_id""",
)
def regime_holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = robust.regime_holdout_summary(robust.regime_holdout(swept(spark, sf_dir), CAND), CAND)
    return rounded(got.drop("worst_regime"))


_CPCV = """
cg AS (SELECT *, least(5, (rn - 1) // (nn // 6)) AS g FROM nb WHERE nn >= 30),
cs AS (SELECT candidate_id, g, min(signal_date) AS f, max(signal_date) AS l FROM cg GROUP BY ALL),
cp AS (SELECT a.candidate_id, a.g AS g1, b.g AS g2, a.f AS f1, a.l AS l1, b.f AS f2, b.l AS l2 FROM cs a JOIN cs b ON a.candidate_id = b.candidate_id AND a.g < b.g),
cx AS (SELECT cp.candidate_id, g1, g2, g IN (g1, g2) AS tst, return_pct > 0 AS w,
  g NOT IN (g1, g2) AND NOT (signal_date BETWEEN f1 - 5 AND l1 + 5) AND NOT (signal_date BETWEEN f2 - 5 AND l2 + 5) AS trn
  FROM cp JOIN cg ON cg.candidate_id = cp.candidate_id),
cv AS (SELECT candidate_id, g1, g2, count(*) FILTER (trn) AS train_n, count(*) FILTER (tst) AS test_n,
  avg(CAST(w AS INT)) FILTER (trn) AS a, avg(CAST(w AS INT)) FILTER (tst) AS b FROM cx GROUP BY candidate_id, g1, g2)"""


@query(
    "g20_c08_cpcv_paths",
    f"""{SWEPT}, {splits_sql('candidate_id')}, {_CPCV} SELECT candidate_id, CAST(g1 AS INT) AS g1, CAST(g2 AS INT) AS g2, train_n, test_n,
    {r('a', 'train_win_rate')}, {r('b', 'test_win_rate')}, {r('abs(a - b)', 'gap')} FROM cv WHERE train_n >= 5 AND test_n >= 5""",
)
def cpcv_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.cpcv_paths(swept(spark, sf_dir), CAND))


@query(
    "g20_cpcv",
    f"""{SWEPT}, {splits_sql('candidate_id')}, {_CPCV} SELECT candidate_id, count(*) AS n_paths, {r('round(avg(abs(a - b)), 4)', 'mean_gap')}, {r('round(max(abs(a - b)), 4)', 'max_gap')},
    {r('round(avg(b), 4)', 'mean_test_win_rate')}, {r('round(coalesce(stddev_samp(b), 0), 4)', 'std_test_win_rate')} FROM cv WHERE train_n >= 5 AND test_n >= 5 GROUP BY candidate_id""",
)
def cpcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.cpcv(robust.cpcv_paths(swept(spark, sf_dir), CAND), CAND))


_CHOICES = {k: list(combinations(range(6), k)) for k in (1, 2, 3)}
_CHOSEN = ", ".join(f"({k}, '{'-'.join(map(str, c))}', {list(c)})" for k, cs in _CHOICES.items() for c in cs)


@query(
    "g20_cpcv_k_of_n",
    f"""{SWEPT}, {splits_sql('candidate_id')}, {_CPCV.split("cp AS")[0]} ch(k, path, tested) AS (VALUES {_CHOSEN}),
    zo AS (SELECT candidate_id, path, f - 5 AS za, l + 5 AS zb FROM ch, cs WHERE list_contains(tested, g)),
    dy AS (SELECT candidate_id, g, signal_date AS d, count(*) AS n, count(*) FILTER (return_pct > 0) AS w FROM cg GROUP BY ALL),
    al AS (SELECT k, path, dy.*, list_contains(tested, g) AS tst, EXISTS (SELECT 1 FROM zo WHERE zo.candidate_id = dy.candidate_id AND zo.path = ch.path AND d BETWEEN za AND zb) AS near FROM ch, dy),
    su AS (SELECT candidate_id, k, path, coalesce(sum(n) FILTER (NOT tst AND NOT near), 0) AS train_n, sum(n) FILTER (tst) AS test_n, sum(w) FILTER (NOT tst AND NOT near) AS tw, sum(w) FILTER (tst) AS sw FROM al GROUP BY ALL)
    SELECT candidate_id, CAST(k AS INT) AS k, path, CAST(train_n AS BIGINT) AS train_n, CAST(test_n AS BIGINT) AS test_n, {r('tw / train_n', 'train_win_rate')}, {r('sw / test_n', 'test_win_rate')} FROM su WHERE train_n >= 5 AND test_n >= 5""",
)
def cpcv_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purged paths with one, two and three test groups out of six."""
    got = swept(spark, sf_dir)
    order = stage(robust.numbered(got, CAND))
    parts = []
    for k in _CHOICES:
        paths = robust.cpcv_paths(got, CAND, test_groups=k, order=order)
        name = F.concat_ws("-", *[F.col(f"g{i + 1}") for i in range(k)])
        parts.append(paths.select("candidate_id", F.lit(k).alias("k"), name.alias("path"), "train_n", "test_n", "train_win_rate", "test_win_rate"))
    return rounded(parts[0].union(parts[1]).union(parts[2]))


@query(
    "c08_purged_train",
    f"""{TAKEN} SELECT symbol, signal_idx, signal_date, {r('return_pct', 'return_pct')} FROM tk
    WHERE NOT (signal_date BETWEEN DATE '1995-05-27' AND DATE '1995-09-05') AND NOT (signal_date BETWEEN DATE '1997-02-24' AND DATE '1997-04-05')""",
)
def purged_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.sql(
        """SELECT DATE '1995-06-01' AS start_date, DATE '1995-08-31' AS end_date
           UNION ALL SELECT DATE '1997-03-01', DATE '1997-03-31'"""
    )
    got = robust.purged_train(taken(spark, sf_dir), ranges)
    return rounded(got.select("symbol", "signal_idx", "signal_date", "return_pct"))


_NEWS_NAMES = ["negative_news_score", "close_above_ma20", "days_since_event", "rsi_14"]


@query(
    "g21_event_coverage",
    f"""{_MERGED}, lb AS (SELECT symbol, max(event_source) AS s FROM merged GROUP BY symbol)
    SELECT count(*) AS total_symbols, count(*) FILTER (s NOT LIKE '%+proxy%' AND s <> 'proxy') AS provider_symbols, count(*) FILTER (s LIKE '%+proxy%') AS mixed_symbols,
    count(*) FILTER (s = 'proxy') AS proxy_symbols, {r("round(count(*) FILTER (s <> 'proxy') / count(*), 4)", 'provider_coverage')},
    {r("round(count(*) FILTER (s = 'proxy') / count(*), 4)", 'proxy_only_coverage')}, ['days_since_event', 'negative_news_score'] AS relevant_indicators FROM lb""",
)
def event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.event_coverage(merged_events(spark, sf_dir), _NEWS_NAMES))


@query(
    "g21_event_source_breakdown",
    f"""{_MERGED}, lb AS (SELECT symbol, max(event_source) AS s FROM merged GROUP BY symbol)
    SELECT replace(s, '+proxy', '') AS provider, count(*) AS symbols FROM lb WHERE s <> 'proxy' GROUP BY 1""",
)
def event_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_source_breakdown(merged_events(spark, sf_dir))


_PATTERNS = """
rm AS (SELECT regime AS label, round(avg(CAST(return_pct > 0 AS INT)), 4) AS wr, round(avg(return_pct), 6) AS ar, count(*) AS n FROM tk WHERE regime IS NOT NULL GROUP BY 1),
sm AS (SELECT sector AS label, round(avg(CAST(return_pct > 0 AS INT)), 4) AS wr, round(avg(return_pct), 6) AS ar, count(*) AS n FROM tk GROUP BY 1),
best AS (SELECT 'best_regime' AS kind, * FROM rm ORDER BY ar DESC, wr DESC LIMIT 1),
weak AS (SELECT 'weak_regime' AS kind, * FROM rm ORDER BY ar, wr LIMIT 1),
edge AS (SELECT 'sector_edge' AS kind, * FROM sm ORDER BY ar DESC, wr DESC LIMIT 1)"""


def _percent(x: str, digits: int) -> str:
    return f"printf('%.{digits}f%%', CAST(round(CAST({x} AS DECIMAL(20, 6)) * 100, {digits}) AS DOUBLE))"


@query(
    "g22_top_patterns",
    f"""{TAKEN}, {_PATTERNS}, al AS (SELECT * FROM best UNION ALL SELECT * FROM weak WHERE label <> (SELECT label FROM best) UNION ALL SELECT * FROM edge),
    hp AS (SELECT avg((l - f) / f) AS b, count(*) AS n FROM (SELECT symbol, arg_min(close, date) AS f, arg_max(close, date) AS l, count(*) AS c FROM bars GROUP BY symbol) WHERE c >= 2 AND f > 0),
    ex AS (SELECT (SELECT sum(return_pct) FROM tk) / greatest(n, 1) - b AS e FROM hp), pv AS (SELECT 0.5 AS c),
    tx AS (SELECT kind, label, wr, n, CASE kind WHEN 'best_regime' THEN 'Best regime fit: ' WHEN 'weak_regime' THEN 'Weak regime: ' ELSE 'Sector edge: ' END || label || ' (win_rate=' || {_percent('wr', 1)} || ', signals=' || n || ')' AS text FROM al
      UNION ALL SELECT 'benchmark', NULL, NULL, NULL, 'Buy-and-hold ' || CASE WHEN e > 0 THEN 'outperformed' ELSE 'lagged' END || ' by ' || {_percent('abs(e)', 2)} FROM ex
      UNION ALL SELECT 'events', NULL, NULL, NULL, 'Event-aware indicators active with ' || {_percent('c', 1)} || ' provider coverage' FROM pv)
    SELECT 'trend' AS strategy_id, kind, label, {r('wr', 'win_rate')}, n AS signal_count, text FROM tx""",
)
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tk, b = taken(spark, sf_dir), t.bars(spark, sf_dir)
    held = baselines.buy_and_hold(b, tk)
    # every other symbol has provider events
    labels = b.select("symbol").distinct().withColumn("event_source", F.when(F.col("symbol") % 2 == 0, "wire").otherwise("proxy"))
    covered = metrics.event_coverage(labels, _NEWS_NAMES)
    regimes, sectors = metrics.by_regime(tk, KEY), metrics.basic_metrics(tk, ["strategy_id", "sector"])
    return rounded(metrics.top_patterns(regimes, sectors, KEY, excess=held, events=covered))


@query(
    "g23_worst_trades",
    f"""{TAKEN}, w AS (SELECT *, row_number() OVER (ORDER BY return_pct, symbol, signal_idx) AS rank FROM tk)
    SELECT rank, symbol, signal_idx, exit_reason, {r('return_pct', 'return_pct')} FROM w WHERE rank <= 10""",
)
def worst_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.worst_trades(taken(spark, sf_dir), KEY)
    return rounded(got.select("rank", "symbol", "signal_idx", "exit_reason", "return_pct"))


@query(
    "g09_equity_series",
    f"""{TAKEN}, c AS (SELECT *, row_number() OVER o AS trade_no, exp(sum(ln(greatest(1 + return_pct, 1e-300))) OVER o) * 100 AS eq FROM tk
      WINDOW o AS (ORDER BY exit_date, symbol, signal_idx ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, max(eq) OVER (ORDER BY trade_no ROWS UNBOUNDED PRECEDING) AS pk FROM c)
    SELECT strategy_id, symbol, signal_idx, trade_no, {r('eq - 100', 'cum_return_pct')}, {r('coalesce((eq - pk) / nullif(pk, 0) * 100, 0)', 'drawdown_pct')} FROM d""",
)
def equity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.equity_series(taken(spark, sf_dir), KEY)
    return rounded(got)


@query(
    "g32_exit_reasons",
    f"{TAKEN} SELECT strategy_id, exit_reason, count(*) AS trades FROM tk GROUP BY ALL",
)
def exit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.exit_reasons(taken(spark, sf_dir), KEY)


@query(
    "g33_return_histogram",
    f"""{TAKEN}, b AS (SELECT min(return_pct * 100) AS lo, max(return_pct * 100) AS hi, least(20, greatest(5, count(*) // 3)) AS k FROM tk),
    q AS (SELECT CAST(least(k - 1, floor((return_pct * 100 - lo) / ((hi - lo) / k))) AS INT) AS bin, lo, (hi - lo) / k AS w FROM tk, b)
    SELECT 'trend' AS strategy_id, bin, {r('lo + bin * w', 'bin_start')}, {r('lo + (bin + 1) * w', 'bin_end')}, count(*) AS trades FROM q GROUP BY bin, lo, w""",
)
def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.return_histogram(taken(spark, sf_dir), KEY))


# ── baselines ────────────────────────────────────────────────────────────────

_BH = f"""{TAKEN},
bh0 AS (SELECT symbol, close, idx, first(close) OVER (PARTITION BY symbol ORDER BY date) AS fc FROM bars),
bh1 AS (SELECT symbol, arg_max(close, idx) AS lc, max(fc) AS fc FROM bh0 GROUP BY symbol),
cu AS (SELECT idx, avg(close / fc) AS v FROM bh0 GROUP BY idx),
cu1 AS (SELECT v / max(v) OVER (ORDER BY idx) - 1 AS dd, v / lag(v) OVER (ORDER BY idx) - 1 AS ret FROM cu),
one AS (SELECT (SELECT avg((lc - fc) / fc) FROM bh1) AS b, (SELECT sum(return_pct) FROM tk) / (SELECT count(*) FROM bh1) AS s,
  (SELECT abs(min(dd)) FROM cu1) AS dd, (SELECT avg(ret) / stddev_samp(ret) * sqrt(252) FROM cu1) AS sh, (SELECT count(*) FROM bh1) AS n)"""


@query(
    "g28_buy_and_hold",
    f"""{_BH} SELECT {r('b', 'benchmark_return')}, {r('s', 'strategy_return')}, {r('s - b', 'excess_return')}, {r('dd', 'benchmark_max_drawdown')},
    {r('sh', 'benchmark_sharpe')}, n AS symbols_used FROM one""",
)
def buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baselines.buy_and_hold(t.bars(spark, sf_dir), taken(spark, sf_dir)))


@query(
    "g29_random_pool",
    f"""{TAKEN}, st AS (SELECT greatest(1, CAST(floor(avg(holding_days)) AS INT)) AS hold FROM tk)
    SELECT a.symbol, a.idx + 1 AS i, {r('(b.close - a.close) / a.close', 'r')} FROM bars a, st, bars b WHERE b.symbol = a.symbol AND b.idx = a.idx + st.hold""",
)
def random_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = baselines.random_pool(t.bars(spark, sf_dir), taken(spark, sf_dir))
    return rounded(got.select("symbol", "i", "r"))


@query(
    "g29_random_baseline",
    f"""{TAKEN}, st AS (SELECT greatest(1, CAST(floor(avg(holding_days)) AS INT)) AS hold, count(*) AS n, avg(return_pct) AS mean FROM tk),
    po AS (SELECT (b.close - a.close) / a.close AS r, row_number() OVER (ORDER BY a.symbol, a.idx) - 1 AS place FROM bars a, st, bars b WHERE b.symbol = a.symbol AND b.idx = a.idx + st.hold AND a.close > 0),
    sz AS (SELECT count(*) AS size, least(count(*), (SELECT n FROM st)) AS n FROM po),
    dr AS (SELECT sim, ('0x' || substr(md5('42|' || sim || '|' || k), 1, 15))::BIGINT % size AS place FROM range(100) a(sim), sz, range(CAST(n AS BIGINT)) b(k)),
    me AS (SELECT sim, avg(r) AS m FROM dr JOIN po USING (place) GROUP BY sim), rk AS (SELECT *, row_number() OVER (ORDER BY m) AS p FROM me)
    SELECT {r('avg(m)', 'random_mean')}, {r('stddev_samp(m)', 'random_std')}, {r('max(m) FILTER (p = 6)', 'ci_lower')}, {r('max(m) FILTER (p = 96)', 'ci_upper')},
    {r('avg(CAST((SELECT mean FROM st) > m AS INT))', 'beat_fraction')}, count(*) AS n_simulations FROM rk HAVING (SELECT size FROM sz) >= 10""",
)
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baselines.random_baseline(stage(t.bars(spark, sf_dir)), taken(spark, sf_dir)))


_STRESS = f"""{TAKEN}, bn AS (SELECT date, avg(close) AS close FROM bars GROUP BY date),
s0 AS (SELECT date, close, row_number() OVER o - 1 AS e, list(close) OVER (ORDER BY date ROWS 19 PRECEDING) AS p, first(date) OVER (ORDER BY date ROWS 19 PRECEDING) AS sd FROM bn WINDOW o AS (ORDER BY date)),
s1 AS (SELECT e, sd, date AS ed, close / p[1] - 1 AS ret, p FROM s0 WHERE e >= 19),
s2 AS (SELECT e, i, p[i] AS px, max(p[i]) OVER (PARTITION BY e ORDER BY i) AS pk FROM s1, range(1, 21) t(i)),
s3 AS (SELECT s1.e, sd, ed, ret, d.dd FROM s1 JOIN (SELECT e, max((pk - px) / pk) AS dd FROM s2 GROUP BY e) d ON d.e = s1.e),
w1 AS (SELECT 1 AS window_num, * FROM s3 ORDER BY ret, dd DESC, e LIMIT 1),
w2 AS (SELECT 2 AS window_num, * FROM s3 WHERE abs(e - (SELECT e FROM w1)) >= 20 ORDER BY ret, dd DESC, e LIMIT 1),
w3 AS (SELECT 3 AS window_num, * FROM s3 WHERE abs(e - (SELECT e FROM w1)) >= 20 AND abs(e - (SELECT e FROM w2)) >= 20 ORDER BY ret, dd DESC, e LIMIT 1),
ws AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3),
wc AS (SELECT window_num, sd AS start_date, ed AS end_date, round(ret, 4) AS benchmark_return, round(dd, 4) AS benchmark_drawdown,
  count(tk.symbol) AS signal_count, round(coalesce(avg(CAST(return_pct > 0 AS INT)), 0), 4) AS strategy_win_rate, round(coalesce(avg(return_pct), 0), 4) AS strategy_avg_return,
  round(coalesce(exp(sum(ln(greatest(1 + return_pct, 1e-300)))) - 1, 0), 4) AS strategy_total_return, round(coalesce(exp(sum(ln(greatest(1 + return_pct, 1e-300)))) - 1, 0) - ret, 4) AS alpha
  FROM ws LEFT JOIN tk ON signal_date <= ed AND coalesce(exit_date, signal_date) >= sd GROUP BY window_num, sd, ed, ret, dd)"""


def _stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = benchmark_from_bars(t.bars(spark, sf_dir))
    return baselines.stress_cases(taken(spark, sf_dir), baselines.stress_windows(index))


@query(
    "g30_c05_stress_windows",
    f"""{_STRESS} SELECT CAST(window_num AS INT) AS window_num, start_date, end_date, signal_count, {r('benchmark_return', 'benchmark_return')}, {r('benchmark_drawdown', 'benchmark_drawdown')},
    {r('strategy_win_rate', 'strategy_win_rate')}, {r('strategy_avg_return', 'strategy_avg_return')}, {r('strategy_total_return', 'strategy_total_return')}, {r('alpha', 'alpha')} FROM wc""",
)
def stress_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stress(spark, sf_dir))


@query(
    "g30_stress_summary",
    f"""{_STRESS} SELECT count(*) AS total_windows, {r('round(avg(CAST(alpha >= 0 AS INT)), 4)', 'pass_rate')}, {r('round(avg(alpha), 4)', 'average_alpha')}, {r('min(alpha)', 'worst_alpha')},
    arg_min(start_date, alpha) AS worst_window_start, arg_min(end_date, alpha) AS worst_window_end, {r('arg_min(benchmark_return, alpha)', 'worst_benchmark_return')} FROM wc""",
)
def stress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baselines.stress_summary(_stress(spark, sf_dir)))


# ── exits and books ──────────────────────────────────────────────────────────

_EXC = f"""{TAKEN},
ex AS (SELECT tk.*, (SELECT max(high) FROM bars b WHERE b.symbol = tk.symbol AND b.idx BETWEEN entry_idx AND exit_idx) AS top,
  (SELECT min(low) FROM bars b WHERE b.symbol = tk.symbol AND b.idx BETWEEN entry_idx AND exit_idx) AS bot,
  (SELECT max(high) FROM bars b WHERE b.symbol = tk.symbol AND b.idx BETWEEN exit_idx + 1 AND exit_idx + 5) AS ph,
  (SELECT min(low) FROM bars b WHERE b.symbol = tk.symbol AND b.idx BETWEEN exit_idx + 1 AND exit_idx + 5) AS pl FROM tk),
em AS (SELECT *, (top - entry_price) / entry_price AS mfe, (bot - entry_price) / entry_price AS mae, (ph - exit_price) / exit_price AS gain, (exit_price - pl) / exit_price AS fall FROM ex),
eg AS (SELECT *, greatest(0, mfe - return_pct) AS giveback FROM em)"""


@query(
    "g31_c06_c07_exit_diagnostics",
    f"""{_EXC} SELECT strategy_id, count(*) AS total_trades, {r('round(avg(mfe), 6)', 'avg_mfe')}, {r('round(avg(mae), 6)', 'avg_mae')}, {r('round(avg(giveback), 6)', 'avg_giveback')},
    count(*) FILTER (exit_reason IN ('take_profit', 'signal', 'max_hold') AND gain >= 0.03) AS sold_early_count,
    count(*) FILTER (gain IS NOT NULL AND mfe >= 0.03 AND giveback >= 0.05) AS sold_late_count,
    count(*) FILTER (exit_reason = 'stop_loss' AND fall >= 0.03) AS stop_loss_effective_count,
    count(*) FILTER (exit_reason = 'take_profit' AND gain >= 0.03) AS take_profit_truncated_count FROM eg GROUP BY strategy_id""",
)
def exit_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = exits.trade_excursions(taken(spark, sf_dir), t.bars(spark, sf_dir), KEY)
    return rounded(exits.exit_diagnostics(seen, KEY))


_BOOK = f"""{TAKEN},
bk0 AS (SELECT symbol, signal_idx, signal_date, entry_price, exit_price, holding_days, 10000.0 / entry_price AS shares,
  CASE WHEN holding_days > 0 THEN list_filter(list_transform(range(1, 2 * holding_days + 4), lambda i: signal_date + CAST(i AS INT)), lambda d: isodow(d) <= 5)[holding_days] END AS until FROM tk),
ds AS (SELECT DISTINCT signal_date AS d FROM bk0),
op AS (SELECT d, count(b.symbol) AS n, coalesce(sum(shares * (CASE WHEN holding_days <= 0 OR d <= signal_date THEN entry_price
   ELSE entry_price + least(1.0, (d - signal_date) / greatest(1, holding_days)) * (exit_price - entry_price) END) - 10000), 0) AS fl
  FROM ds LEFT JOIN bk0 b ON b.signal_date <= d AND (until IS NULL OR d < until) GROUP BY d),
rl AS (SELECT d, coalesce(sum(shares * (exit_price - entry_price)), 0) AS pnl FROM ds LEFT JOIN bk0 ON until <= d GROUP BY d),
cv0 AS (SELECT op.d AS date, n AS positions_open, 100000.0 + pnl + fl AS equity FROM op JOIN rl ON op.d = rl.d),
cvx AS (SELECT *, equity / lag(equity, 1, 100000.0) OVER (ORDER BY date) - 1 AS daily_return, lag(equity, 1, 100000.0) OVER (ORDER BY date) AS prev FROM cv0)"""


@query(
    "f01_f03_exposure_curve",
    f"{_BOOK} SELECT date, CAST(positions_open AS BIGINT) AS positions_open, {r('equity', 'equity', 4)}, {r('CASE WHEN prev > 0 THEN daily_return ELSE 0 END', 'daily_return', 4)} FROM cvx",
)
def exposure_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.exposure_curve(taken(spark, sf_dir)), 4)


@query(
    "f04_f08_book_summary",
    f"""{_BOOK}, pk AS (SELECT *, max(equity) OVER (ORDER BY date) AS peak FROM cvx)
    SELECT (SELECT count(*) FROM tk) AS total_trades, {r('(SELECT avg(CAST(exit_price > entry_price AS INT)) FROM tk)', 'win_rate')}, {r('max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END)', 'max_drawdown')},
    {r('(avg(CASE WHEN prev > 0 AND daily_return <> 0 THEN daily_return END) - 0.02 / 252) / stddev_samp(CASE WHEN prev > 0 AND daily_return <> 0 THEN daily_return END) * sqrt(252)', 'sharpe_ratio')},
    CAST(max(positions_open) AS BIGINT) AS max_concurrent_positions, {r('least(1.0, avg(positions_open * 0.1 / 10))', 'capital_utilization')}, {r('arg_max(equity, date) / 100000 - 1', 'total_return')} FROM pk""",
)
def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tk = taken(spark, sf_dir)
    return rounded(book.book_summary(book.exposure_curve(tk), tk))


@query(
    "f01_f02_estimated_exits",
    f"""{_BOOK} SELECT symbol, signal_idx, until AS estimated_exit, {r('CASE WHEN holding_days <= 0 THEN entry_price ELSE entry_price + least(1.0, 3 / greatest(1, holding_days)) * (exit_price - entry_price) END', 'price_after_3_days')} FROM bk0""",
)
def estimated_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tk = taken(spark, sf_dir)
    later = book.interpolated_price(F.date_add("signal_date", 3)).alias("price_after_3_days")
    return rounded(tk.select("symbol", "signal_idx", book.estimated_exit().alias("estimated_exit"), later))


# ── sweeps over entry numbers ────────────────────────────────────────────────

_LEVELS = {"m1": -0.05, "m2": 0.0, "m3": 0.05}
_ENTRY_GRID = "(VALUES " + ", ".join(f"('{k}', 0.10, 2.0, 10, {v})" for k, v in _LEVELS.items()) + ") c(candidate_id, stop_v, target_v, hold, mom_v)"
_ENTRY_CANDS = [
    sweep.Candidate(k, replace(BASE, entry=replace(BASE.entry, guards=(Condition("momentum_10d", ">", v),))))
    for k, v in _LEVELS.items()
]
_ENTRY_SWEEP = "WITH RECURSIVE " + trades_sql(base=BASE_SQL, cand=_ENTRY_GRID, columns=f"{_momentum(10)} AS mom", entry_cand="mom > mom_v") + ", tk AS (SELECT * FROM taken)"


@query(
    "i05_c10_entry_sweep",
    f"{_ENTRY_SWEEP} SELECT candidate_id, symbol, signal_idx, exit_idx, exit_reason, {r('return_pct', 'return_pct')} FROM tk",
)
def entry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sweep.sweep_trades(t.bars(spark, sf_dir), _ENTRY_CANDS)
    return rounded(got.select("candidate_id", "symbol", "signal_idx", "exit_idx", "exit_reason", "return_pct"))


STOP_VALUE = sweep.Tunable(
    "exit.stop.value", 0.05, 0.105, 0.02, lambda s: s.exit.stop.value, lambda s, v: replace(s, exit=replace(s.exit, stop=replace(s.exit.stop, value=v)))
)
TARGET_VALUE = sweep.Tunable(
    "exit.target.value", 1.0, 4.0, 0.5, lambda s: s.exit.target.value, lambda s, v: replace(s, exit=replace(s.exit, target=replace(s.exit.target, value=v)))
)
_PERTURB_SQL = "(VALUES ('base', 0.10, 2.0, 10), ('v0', 0.09, 2.0, 10), ('v1', 0.105, 2.0, 10), ('v2', 0.10, 1.8, 10), ('v3', 0.10, 2.2, 10)) c(candidate_id, stop_v, target_v, hold)"


def _plain_confidence() -> str:
    return f"""round(least(1, greatest(0, 0.25 * least(1, win_rate / 0.7) + 0.15 * least(1, greatest(0, avg_return / 0.05)) + 0.15 * least(1, profit_loss_ratio / 2.5)
    + 0.15 * greatest(0, 1 - max_drawdown / 0.30) + 0.10 * least(1, greatest(0, sharpe_ratio / 2.0)) + 0.05 + 0.05 - {_COMPLEX * 0.10})), 4)"""


@query(
    "g27_param_sensitivity",
    f"""WITH RECURSIVE {trades_sql(base=BASE_SQL, cand=_PERTURB_SQL)}, tk AS (SELECT * FROM taken), {metrics_sql('candidate_id')},
    sc AS (SELECT candidate_id, {_plain_confidence()} AS s FROM om), b AS (SELECT s AS bs FROM sc WHERE candidate_id = 'base')
    SELECT {r('round(avg(greatest(0, bs - s) / bs), 4)', 'param_sensitivity')}, count(*) AS variants FROM sc, b WHERE candidate_id <> 'base'""",
)
def param_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sweep.param_sensitivity(t.bars(spark, sf_dir), BASE, sweep.perturbed(BASE, [STOP_VALUE, TARGET_VALUE])))


# ── scores and rankings of the candidates ────────────────────────────────────


def _cl(expr: str) -> str:
    return f"least(1, greatest(0, {expr}))"


_SCORES = f"""{EVALS},
sc0 AS (SELECT *, (train_val_gap > 0.15 OR val_test_gap > 0.10) AS over,
  round((0.30 * {_cl('(win_rate - 0.45) / 0.15')} + 0.30 * {_cl('avg_return / 0.02')} + 0.20 * {_cl('profit_loss_ratio - 1.0')} + 0.20 * {_cl('1 - max_drawdown / 0.40')}) * {_cl('signal_count / 30.0')}, 6) AS quality,
  round((0.35 * {_cl('avg_return / 0.015')} + 0.20 * {_cl('total_return / 0.20')} + 0.20 * {_cl('(profit_loss_ratio - 1.0) / 1.5')} + 0.15 * {_cl('(win_rate - 0.45) / 0.15')} + 0.10 * {_cl('1 - max_drawdown / 0.35')})
    * (CASE WHEN avg_return <= 0 OR profit_loss_ratio < 1.0 THEN 0.25 ELSE 1.0 END) * {_cl('signal_count / 30.0')}, 6) AS profit_quality FROM ev),
sc1 AS (SELECT *, round(0.30 * {_cl('1 - train_val_gap / 0.20')} + 0.25 * {_cl('1 - val_test_gap / 0.15')} + 0.20 * 0.65 + 0.15 * 0.65 + 0.10 * (CASE WHEN over THEN 0 ELSE 1 END), 6) AS robustness FROM sc0),
sc AS (SELECT *, round(0.65 * profit_quality + 0.35 * robustness, 6) AS robust_profit_quality, win_rate < 0.44 OR signal_count < 3500 OR max_drawdown > 0.9999 OR over AS failed FROM sc1),
rk AS (SELECT *, row_number() OVER (ORDER BY (NOT failed) DESC, robust_profit_quality DESC, robustness DESC, profit_quality DESC, quality DESC, confidence_score DESC, avg_return DESC,
   total_return DESC, profit_loss_ratio DESC, signal_count DESC, max_drawdown, candidate_id) AS rank FROM sc)"""

_GATES = {"min_win_rate": 0.44, "min_signals": 3500, "max_drawdown": 0.9999, "reject_overfit": True}


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = stage(evaluations(swept(spark, sf_dir)))
    return ranking.rank_candidates(evals, "robust_profit_quality", **_GATES)


@query(
    "i06_scores",
    f"{_SCORES} SELECT candidate_id, {r('quality', 'quality')}, {r('profit_quality', 'profit_quality')}, {r('robustness', 'robustness')}, {r('robust_profit_quality', 'robust_profit_quality')} FROM sc",
)
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranking.with_scores(evaluations(swept(spark, sf_dir)))
    return rounded(got.select("candidate_id", "quality", "profit_quality", "robustness", "robust_profit_quality"))


@query(
    "b12_i07_ranked_candidates",
    f"""{_SCORES} SELECT candidate_id, rank, NOT failed AS passed_gate,
    array_to_string(list_filter([CASE WHEN win_rate < 0.44 THEN 'win_rate<44.0%' END, CASE WHEN max_drawdown > 0.9999 THEN 'max_drawdown>100.0%' END,
      CASE WHEN signal_count < 3500 THEN 'signals<3500' END, CASE WHEN over THEN 'overfit_detected' END], lambda x: x IS NOT NULL), ';') AS gate_reasons FROM rk""",
)
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranked(spark, sf_dir)
    return got.select("candidate_id", "rank", "passed_gate", F.concat_ws(";", "gate_reasons").alias("gate_reasons"))


_ORDERED = """(NOT failed) DESC, robust_profit_quality DESC, robustness DESC, profit_quality DESC, quality DESC, confidence_score DESC, avg_return DESC,
   total_return DESC, profit_loss_ratio DESC, signal_count DESC, max_drawdown, candidate_id"""


@query(
    "i08_joint_ranking",
    f"""{_SCORES}, jr AS (SELECT 'a_' || candidate_id AS candidate_id, * EXCLUDE (candidate_id, rank) FROM rk WHERE candidate_id <= 'c06'
      UNION ALL SELECT 'b_' || candidate_id, * EXCLUDE (candidate_id, rank) FROM rk WHERE candidate_id > 'c04')
    SELECT candidate_id, row_number() OVER (ORDER BY {_ORDERED}) AS rank FROM jr""",
)
def joint_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = stage(evaluations(swept(spark, sf_dir)))
    a = evals.where("candidate_id <= 'c06'").withColumn("candidate_id", F.concat(F.lit("a_"), "candidate_id"))
    b = evals.where("candidate_id > 'c04'").withColumn("candidate_id", F.concat(F.lit("b_"), "candidate_id"))
    got = ranking.rank_candidates(a.unionByName(b), "robust_profit_quality", **_GATES)
    return got.select("candidate_id", "rank")


@query(
    "i09_diverse_seeds",
    f"""{_SCORES}, p0 AS (SELECT candidate_id FROM rk WHERE rank = 1),
    p1 AS (SELECT candidate_id FROM rk WHERE candidate_id NOT IN (SELECT * FROM p0) ORDER BY win_rate DESC, rank LIMIT 1),
    p2 AS (SELECT candidate_id FROM rk WHERE candidate_id NOT IN (SELECT * FROM p0 UNION ALL SELECT * FROM p1) ORDER BY avg_return DESC, rank LIMIT 1),
    p3 AS (SELECT candidate_id FROM rk WHERE candidate_id NOT IN (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) ORDER BY total_return DESC, rank LIMIT 1),
    p4 AS (SELECT candidate_id FROM rk WHERE candidate_id NOT IN (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) ORDER BY profit_loss_ratio DESC, rank LIMIT 1),
    p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4),
    f AS (SELECT candidate_id FROM rk WHERE candidate_id NOT IN (SELECT * FROM p) ORDER BY rank LIMIT 1)
    SELECT candidate_id, CAST(rank AS BIGINT) AS rank FROM rk WHERE candidate_id IN (SELECT * FROM p UNION ALL SELECT * FROM f)""",
)
def diverse_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranking.diverse_seeds(stage(ranked(spark, sf_dir)), 6, min_signals=1)
    return got.select("candidate_id", F.col("rank").cast("long").alias("rank"))


@query(
    "i10_high_win_return_pick",
    f"""{_SCORES}, hw AS (SELECT *, round((0.30 * {_cl('(win_rate - 0.45) / 0.15')} + 0.30 * {_cl('avg_return / 0.02')} + 0.25 * {_cl('total_return / 0.50')} + 0.10 * {_cl('(profit_loss_ratio - 1.0) / 1.5')}
       + 0.05 * {_cl('1 - max_drawdown / 0.35')}) * {_cl('signal_count / 30.0')}, 6) AS hs FROM sc)
    SELECT 'all' AS pool, candidate_id, {r('hs', 'high_win_return')} FROM hw ORDER BY (NOT failed) DESC, hs DESC, win_rate DESC, avg_return DESC LIMIT 1""",
)
def high_win_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranked(spark, sf_dir).withColumn("pool", F.lit("all"))
    return rounded(ranking.high_win_return_pick(got, ["pool"]))


@query(
    "i11_screened_pick",
    f"""{_SCORES}, b AS (SELECT signal_count AS bn FROM sc WHERE candidate_id = 'c01')
    SELECT 'all' AS pool, candidate_id, {r('confidence_score', 'confidence_score')}, signal_count FROM sc, b
    ORDER BY (signal_count >= 30) DESC, (NOT over) DESC, (signal_count / bn >= 0.70) DESC, signal_count / bn DESC, confidence_score DESC, candidate_id DESC LIMIT 1""",
)
def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = stage(evaluations(swept(spark, sf_dir)))
    base = evals.where("candidate_id = 'c01'").select(
        F.col("signal_count").alias("base_signals"), F.col("confidence_score").alias("base_score")
    )
    both = with_row(evals, base).withColumn("pool", F.lit("all"))
    return rounded(ranking.screened_pick(both, ["pool"]))


@query(
    "g34_g38_verdicts",
    f"""{_SCORES} SELECT candidate_id, CASE WHEN signal_count < 4000 THEN 'Sparse-signal result (' || signal_count || '/4000)'
      WHEN over THEN 'Overfit detected (train_val_gap=' || format('{{:.1f}}', train_val_gap * 100) || '%)' WHEN avg_return <= 0 AND total_return <= 0 THEN 'Non-positive trade payoff (avg_return=' || format('{{:.2f}}', avg_return * 100) || '%, total_return=' || format('{{:.2f}}', total_return * 100) || '%)' END AS guard,
    CASE WHEN signal_count < 30 THEN 'insufficient_evidence' WHEN win_rate >= 0.52 AND (avg_return <= 0 OR profit_loss_ratio < 1.2) THEN 'optimize_exits'
      WHEN over THEN 'simplify_structure' WHEN win_rate < 0.45 OR avg_return < 0 THEN 'revise_entry' ELSE 'continue_validation' END AS advice,
    array_to_string(list_filter([CASE WHEN signal_count < 25 THEN 'low_signals' END, CASE WHEN win_rate < 0.45 THEN 'low_win_rate' END, CASE WHEN max_drawdown > 0.20 THEN 'high_drawdown' END,
      CASE WHEN profit_loss_ratio < 1.5 AND win_rate >= 0.45 THEN 'low_pl_ratio' END, CASE WHEN train_val_gap > 0.10 THEN 'overfit' END], lambda x: x IS NOT NULL), ';') AS problems FROM sc""",
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = evaluations(swept(spark, sf_dir)).withColumn("walk_forward_gap", F.lit(None).cast("double"))
    return evals.select(
        "candidate_id",
        ranking.promotion_guard(4000).alias("guard"),
        ranking.research_status(F.lit(None).cast("double")).alias("advice"),
        F.concat_ws(";", ranking.problem_labels()).alias("problems"),
    )


@query(
    "g35_committee",
    f"""{_SCORES}, v AS (SELECT candidate_id, CASE WHEN signal_count < 30 OR avg_return <= 0 THEN 'fail' WHEN profit_loss_ratio < 1.0 THEN 'watch' ELSE 'pass' END AS technical,
      CASE WHEN max_drawdown > 0.45 THEN 'fail' WHEN max_drawdown > 0.30 OR max_consecutive_loss >= 8 THEN 'watch' ELSE 'pass' END AS risk,
      CASE WHEN signal_count < 30 OR over THEN 'fail' WHEN signal_count < 60 THEN 'watch' ELSE 'pass' END AS overfit,
      CASE WHEN symbols < 5 OR proxies > 0 THEN 'watch' ELSE 'pass' END AS data_quality, CASE WHEN changes = 0 THEN 'watch' ELSE 'pass' END AS mutation
      FROM sc JOIN (SELECT candidate_id, count(DISTINCT symbol) AS symbols, avg(symbol % 2) AS proxies FROM tk WHERE return_pct > 0.25 GROUP BY 1) fa USING (candidate_id)
      JOIN (SELECT candidate_id, CAST(stop_v <> 0.10 AS INT) + CAST(target_v <> 2.5 AS INT) + CAST(hold <> 10 AS INT) AS changes FROM {GRID_SQL}) pl USING (candidate_id)),
    w AS (SELECT *, CASE WHEN 'fail' IN (technical, risk, overfit) THEN 'fail' ELSE 'watch' END AS overall FROM v)
    UNPIVOT w ON technical, risk, overfit, data_quality, mutation, overall INTO NAME analyst VALUE status""",
)
def committee(spark: SparkSession, sf_dir: str) -> DataFrame:
    # symbols with large gains, those of odd numbers without provider events, and changes against the candidate of 10 %, 2.5 and 10 bars
    tk = swept(spark, sf_dir)
    large = tk.where("return_pct > 0.25")
    facts = large.groupBy("candidate_id").agg(F.countDistinct("symbol").alias("symbols"), F.avg(F.col("symbol") % 2).alias("proxies"))
    plan = [(i, int(s != 0.10) + int(g != 2.5) + int(h != 10)) for i, s, g, h in GRID]
    changes = spark.createDataFrame(plan, "candidate_id string, changes int")
    evals = evaluations(tk).join(facts, "candidate_id").join(changes, "candidate_id")
    return ranking.committee(evals, CAND, symbols=F.col("symbols"), proxy_share=F.col("proxies"), planned_changes=F.col("changes"))


@query(
    "g37_hypothesis_status",
    f"""{_SCORES}, rm AS (SELECT candidate_id, regime, round(avg(CAST(return_pct > 0 AS INT)), 4) AS wr, round(avg(return_pct), 6) AS ar FROM tk WHERE regime IS NOT NULL GROUP BY ALL),
    wk AS (SELECT DISTINCT candidate_id AS wid FROM rm WHERE regime = 'trending_up' AND (wr < 0.45 OR ar < 0))
    SELECT candidate_id, CASE WHEN signal_count < 30 THEN 'unproven_small_sample' WHEN win_rate >= 0.52 AND avg_return <= 0 THEN 'execution_misaligned'
      WHEN wid IS NOT NULL AND (win_rate < 0.46 OR avg_return <= 0 OR train_val_gap <= 0.20) THEN 'thesis_misaligned'
      WHEN over OR train_val_gap > 0.10 THEN 'parameter_misaligned' ELSE 'partially_validated' END AS hypothesis_status FROM sc LEFT JOIN wk ON wid = candidate_id""",
)
def hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    tk = swept(spark, sf_dir)
    evals = sweep.fast_report(tk, sweep.roster(CANDIDATES, tk))
    got = ranking.hypothesis_status(evals, metrics.by_regime(tk, CAND), CAND, ("trending_up",))
    return got.select("candidate_id", "hypothesis_status")


_FULL = f"""{EVALS}, {WALK}, {_HOLDOUT}, {_CPCV},
    fo AS (SELECT candidate_id, round(avg(round(abs(a - b), 4)), 4) AS fg, round(avg(CAST(round(abs(a - b), 4) <= 0.10 AS INT)), 4) AS fp FROM wf GROUP BY candidate_id),
    hs AS (SELECT candidate_id, max(gap) AS hg, round(avg(CAST(gap <= 0.10 AS INT)), 4) AS hp FROM ho GROUP BY candidate_id),
    cq AS (SELECT candidate_id, count(*) AS n_paths, round(avg(abs(a - b)), 4) AS mg FROM cv WHERE train_n >= 5 AND test_n >= 5 GROUP BY candidate_id)
    SELECT candidate_id, {r('confidence_score', 'confidence_score')}, signal_count, {r('train_val_gap', 'train_val_gap')}, {r('fg', 'walk_forward_gap')}, {r('fp', 'walk_forward_pass_rate')},
    {r('hg', 'holdout_worst_gap')}, {r('hp', 'holdout_pass_rate')}, n_paths, {r('mg', 'mean_gap')}
    FROM ev LEFT JOIN fo USING (candidate_id) LEFT JOIN hs USING (candidate_id) LEFT JOIN cq USING (candidate_id)"""
_FULL_COLUMNS = [
    "candidate_id", "confidence_score", "signal_count", "train_val_gap", "walk_forward_gap", "walk_forward_pass_rate",
    "holdout_worst_gap", "holdout_pass_rate", "n_paths", "mean_gap",
]


@query("g26_full_report", _FULL)
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tk = swept(spark, sf_dir)
    return rounded(sweep.full_report(tk, sweep.roster(CANDIDATES, tk)).select(*_FULL_COLUMNS))


@query("i05_two_phase", f"{_FULL} WHERE candidate_id IN (SELECT candidate_id FROM ev ORDER BY confidence_score DESC, candidate_id LIMIT 4)")
def two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    tk = swept(spark, sf_dir)
    return rounded(sweep.two_phase(tk, sweep.roster(CANDIDATES, tk), 4).select(*_FULL_COLUMNS))
