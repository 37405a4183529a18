"""Queries over factors, samples, lessons, lineage and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import spec
from tapeloom.functions.indicators import with_indicators
from tapeloom.operators import factors, lessons, lineage, ranking, sampling
from tapeloom.plans import tables as t
from tapeloom.plans.bar_queries import BARS, W, _momentum, _SIMPLE, lag
from tapeloom.plans.registry import query, r, rounded
from tapeloom.plans.trade_queries import BASE
from tapeloom.runtime import shared_path, stage
from tapeloom.sources import bars as src
from tapeloom.sources import export

# ── factors ──────────────────────────────────────────────────────────────────

_GAP = "coalesce((open - lag(close) OVER w) / lag(close) OVER w, 0.0)"
OBS_SQL = f"""{BARS},
obs AS (SELECT symbol, date, idx, {_momentum(10)} AS f, {_GAP} AS g, lead(close, 5) OVER w / close - 1 AS r FROM bars WINDOW w AS ({W})),
cl AS (SELECT * FROM obs WHERE r IS NOT NULL)"""


def rank_sql(part: str, col: str) -> str:
    by = f"PARTITION BY {part}, {col}" if part else f"PARTITION BY {col}"
    over = f"PARTITION BY {part} ORDER BY {col}" if part else f"ORDER BY {col}"
    return f"(rank() OVER ({over}) + (count(*) OVER ({by}) - 1) / 2.0)"


_DAILY = f"""{OBS_SQL}, dr AS (SELECT date, {rank_sql('date', 'f')} AS rf, {rank_sql('date', 'r')} AS rr FROM cl),
ic AS (SELECT date, corr(rf, rr) AS ic, count(*) AS n FROM dr GROUP BY date HAVING count(*) >= 4 AND stddev_pop(rf) > 0 AND stddev_pop(rr) > 0)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = with_indicators(t.bars_by_symbol(spark, sf_dir), ["momentum_10d", "gap_up_pct"])
    obs = factors.forward_return(b, 5)
    return stage(obs.select("symbol", "date", F.col("momentum_10d").alias("f"), F.col("gap_up_pct").alias("g"), "r"))


@query("h02_daily_rank_ic", f"{_DAILY} SELECT date, {r('ic', 'ic')}, n FROM ic")
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.daily_ic(observations(spark, sf_dir)))


@query(
    "h03_ic_summary",
    f"""{_DAILY} SELECT count(*) AS ic_dates, {r('avg(ic)', 'ic_mean')}, {r('stddev_pop(ic)', 'ic_std')}, {r('avg(ic) / stddev_pop(ic)', 'ir')} FROM ic""",
)
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.ic_summary(factors.daily_ic(observations(spark, sf_dir))))


_POOLED = f"""{OBS_SQL}, po AS (SELECT f, r, row_number() OVER (ORDER BY date, symbol) - 1 AS pos, greatest(count(*) OVER () // 5, 10) AS size, count(*) OVER () AS n FROM cl),
pk AS (SELECT {rank_sql('', 'f')} AS rf, {rank_sql('', 'r')} AS rr FROM cl),
ck AS (SELECT pos // size AS c, {rank_sql('pos // size', 'f')} AS rf, {rank_sql('pos // size', 'r')} AS rr FROM po WHERE (pos // size + 1) * size <= n),
ci AS (SELECT corr(rf, rr) AS ic FROM ck GROUP BY c)"""


@query(
    "h03_pooled_ic",
    f"{_POOLED} SELECT {r('(SELECT corr(rf, rr) FROM pk)', 'ic_mean')}, {r('stddev_pop(ic)', 'ic_std')} FROM ci",
)
def pooled_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.pooled_ic(observations(spark, sf_dir)))


@query(
    "h04_monthly_win_rate",
    f"""{_DAILY}, mo AS (SELECT date_trunc('month', date) AS m, avg(ic) AS a FROM ic GROUP BY 1)
    SELECT {r('avg(CAST(round(a, 12) > 0 AS INT))', 'monthly_win_rate')}, count(*) AS months FROM mo""",
)
def monthly_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.monthly_win_rate(factors.daily_ic(observations(spark, sf_dir))))


@query(
    "h04_monthly_pooled_win_rate",
    f"""{OBS_SQL}, mr AS (SELECT date_trunc('month', date) AS m, {rank_sql("date_trunc('month', date)", 'f')} AS rf, {rank_sql("date_trunc('month', date)", 'r')} AS rr FROM cl),
    mi AS (SELECT corr(rf, rr) AS a FROM mr GROUP BY m HAVING count(*) >= 5 AND stddev_pop(rf) > 0 AND stddev_pop(rr) > 0)
    SELECT {r('avg(CAST(round(a, 12) > 0 AS INT))', 'monthly_win_rate')}, count(*) AS months FROM mi""",
)
def monthly_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.monthly_pooled_ic(observations(spark, sf_dir)))


@query(
    "h04_bucket_win_rate",
    f"""{OBS_SQL}, po AS (SELECT f, r, (row_number() OVER (ORDER BY date, symbol) - 1) // greatest(count(*) OVER () // 12, 5) AS b FROM cl),
    br AS (SELECT b, {rank_sql('b', 'f')} AS rf, {rank_sql('b', 'r')} AS rr FROM po),
    bi AS (SELECT corr(rf, rr) AS a FROM br GROUP BY b HAVING count(*) >= 5 AND stddev_pop(rf) > 0 AND stddev_pop(rr) > 0)
    SELECT {r('avg(CAST(round(a, 12) > 0 AS INT))', 'monthly_win_rate')}, count(*) AS months FROM bi""",
)
def bucket_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.bucket_win_rate(observations(spark, sf_dir)))


_TURN = f"""{OBS_SQL}, sz AS (SELECT date, row_number() OVER (ORDER BY date) AS dn FROM (SELECT date FROM obs GROUP BY date HAVING count(*) >= 4)),
tr AS (SELECT symbol, dn, {rank_sql('obs.date', 'f')} AS rk FROM obs JOIN sz ON sz.date = obs.date),
tp AS (SELECT a.dn, avg(abs(a.rk - b.rk)) AS mv, count(*) AS c FROM tr a JOIN tr b ON a.symbol = b.symbol AND a.dn = b.dn + 1 GROUP BY a.dn HAVING count(*) >= 4)"""


@query("h05_rank_turnover", f"{_TURN} SELECT {r('avg(mv / c)', 'turnover')}, count(*) AS steps FROM tp")
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.turnover(observations(spark, sf_dir)))


@query(
    "h05_half_split_turnover",
    f"""{OBS_SQL}, po AS (SELECT f, row_number() OVER (ORDER BY date, symbol) - 1 AS pos, count(*) OVER () // 2 AS half FROM obs),
    hr AS (SELECT pos // half AS p, pos % half AS q, half, {rank_sql('pos // half', 'f')} AS rk FROM po WHERE pos // half < 2)
    SELECT {r('avg(abs(a.rk - b.rk)) / max(a.half)', 'turnover')} FROM hr a JOIN hr b ON a.q = b.q AND a.p = 0 AND b.p = 1""",
)
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.half_split_turnover(observations(spark, sf_dir)))


@query(
    "h06_cross_factor_correlation",
    f"""{OBS_SQL}, xr AS (SELECT {rank_sql('', 'f')} AS ra, {rank_sql('', 'g')} AS rb FROM obs) SELECT {r('corr(ra, rb)', 'correlation')}, count(*) AS n FROM xr""",
)
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return rounded(factors.cross_correlation(obs.select(F.col("f").alias("a"), F.col("g").alias("b"))))


_VALID = f"""{_DAILY}, mo AS (SELECT avg(ic) AS a FROM ic GROUP BY date_trunc('month', date)), {_TURN.split('cl AS (SELECT * FROM obs WHERE r IS NOT NULL),')[1]},
xr AS (SELECT {rank_sql('', 'f')} AS ra, {rank_sql('', 'g')} AS rb FROM obs),
v AS (SELECT (SELECT avg(ic) FROM ic) AS m, (SELECT stddev_pop(ic) FROM ic) AS s, (SELECT avg(CAST(round(a, 12) > 0 AS INT)) FROM mo) AS w, (SELECT avg(mv / c) FROM tp) AS tv, (SELECT corr(ra, rb) FROM xr) AS x)"""


@query(
    "h01_factor_validation",
    f"""{_VALID} SELECT {r('m', 'ic_mean')}, {r('m / s', 'ir')}, {r('w', 'monthly_win_rate')}, {r('tv', 'turnover')}, {r('x', 'corr_gap')},
    array_to_string(list_filter([CASE WHEN m < 0.02 THEN 'ic_mean' END, CASE WHEN m / s < 0.3 THEN 'ir' END, CASE WHEN w < 0.5 THEN 'monthly_win_rate' END,
      CASE WHEN tv > 0.8 THEN 'turnover' END, CASE WHEN abs(x) > 0.7 THEN 'correlated_gap' END], lambda z: z IS NOT NULL), ';') AS reasons FROM v""",
)
def factor_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = factors.validate(observations(spark, sf_dir), others={"gap": F.col("g")})
    names = ["ic_mean", "ir", "monthly_win_rate", "turnover", "corr_gap"]
    return rounded(got.select(*names, F.concat_ws(";", "reasons").alias("reasons")))


def _stretch(pdf):
    return (pdf["close"] / pdf["close"].rolling(5).mean() - 1).fillna(0.0)


@query(
    "h07_k04_grouped_factor",
    f"""{BARS} SELECT symbol, date, {r(f'CASE WHEN idx >= 4 THEN close / avg(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - 1 ELSE 0 END', 'stretch')} FROM bars""",
)
def grouped_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = factors.grouped_factor(t.bars(spark, sf_dir), _stretch, "stretch")
    return rounded(got.select("symbol", "date", "stretch"))


@query(
    "h08_leak_check",
    f"""{BARS}, z AS (SELECT symbol, date, lead(date) OVER ({W}) AS nd FROM bars) SELECT symbol, date FROM z
    WHERE date <= DATE '1997-06-30' AND nd > DATE '1997-06-30'""",
)
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    def peeking(b: DataFrame) -> DataFrame:
        return factors.forward_return(b, 1, name="peek")

    got = factors.leak_check(t.bars(spark, sf_dir), peeking, "peek", F.lit("1997-06-30").cast("date"))
    return got.select("symbol", "date")


_FLOG = """
flog AS (SELECT p_brand || '_' || p_size AS name, CASE WHEN p_retailprice > 950 THEN 'retired' ELSE 'active' END AS status,
  p_retailprice / 1000 AS ir, p_partkey AS updated_at FROM part),
cur AS (SELECT name, arg_max(status, updated_at) AS status, arg_max(ir, updated_at) AS ir FROM flog GROUP BY name)"""


def factor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "part").select(
        F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("name"),
        F.when(F.col("p_retailprice") > 950, "retired").otherwise("active").alias("status"),
        (F.col("p_retailprice") / 1000).alias("ir"),
        F.col("p_partkey").alias("updated_at"),
    )


@query("h09_top_factors", f"WITH {_FLOG} SELECT name, status, {r('ir', 'ir')} FROM cur WHERE status = 'active' ORDER BY cur.ir DESC, name LIMIT 10")
def top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lessons.top_factors(lessons.current_factors(factor_log(spark, sf_dir)))
    return rounded(got.select("name", "status", "ir"))


@query("h10_factor_counts", f"WITH {_FLOG} SELECT status, count(*) AS factors FROM cur GROUP BY status")
def factor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lessons.factor_counts(lessons.current_factors(factor_log(spark, sf_dir)))


@query(
    "d58_intra_sector_strength",
    f"""{BARS}, {t.SQL_UNIVERSE}, m AS (SELECT bars.symbol, date, sector, {_momentum(10)} AS f FROM bars JOIN universe USING (symbol))
    SELECT symbol, date, {r('percent_rank() OVER (PARTITION BY date, sector ORDER BY f DESC)', 'intra_sector_strength_rank_pct')} FROM m""",
)
def sector_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = with_indicators(t.bars(spark, sf_dir), ["momentum_10d"])
    joined = b.join(t.universe(spark, sf_dir).select("symbol", "sector"), "symbol")
    got = factors.sector_strength(stage(joined.select("symbol", "date", "sector", "momentum_10d")), "momentum_10d")
    return rounded(got.select("symbol", "date", "intra_sector_strength_rank_pct"))


# ── samples ──────────────────────────────────────────────────────────────────

_LIMITS = sampling.Limits(max_symbols=40, min_symbols=10)
_UNI = f"WITH {t.SQL_UNIVERSE}"


@query(
    "j01_j03_sector_picks",
    f"""{_UNI}, a AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY market_cap DESC, symbol) - 1 AS pos, count(*) OVER (PARTITION BY sector) AS size,
      count(*) OVER () AS total, greatest(10, least(40, count(*) OVER ())) AS target FROM universe),
    b AS (SELECT *, greatest(1, CAST(round_even(size / total * target, 0) AS INT)) AS n FROM a)
    SELECT symbol, sector FROM b WHERE n >= size OR pos IN (SELECT CAST(floor(g * (b.size / b.n)) AS BIGINT) FROM generate_series(0, b.n - 1) AS s(g))""",
)
def sector_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sampling.sector_picks(t.universe(spark, sf_dir), _LIMITS)
    return got.where("_picked").select("symbol", "sector")


@query(
    "j01_j02_representative_sample",
    f"""{_UNI}, a AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY market_cap DESC, symbol) - 1 AS pos, count(*) OVER (PARTITION BY sector) AS size,
      count(*) OVER () AS total, greatest(10, least(40, count(*) OVER ())) AS target FROM universe),
    b AS (SELECT *, greatest(1, CAST(round_even(size / total * target, 0) AS INT)) AS n FROM a),
    c AS (SELECT *, n >= size OR pos IN (SELECT CAST(floor(g * (b.size / b.n)) AS BIGINT) FROM generate_series(0, b.n - 1) AS s(g)) AS picked FROM b),
    d AS (SELECT *, row_number() OVER (ORDER BY picked DESC, md5('42|' || CAST(symbol AS VARCHAR)), symbol) AS rk, count(*) FILTER (picked) OVER () AS np FROM c)
    SELECT symbol, sector, CAST(rk AS INT) AS symbol_rank FROM d WHERE rk <= CASE WHEN np > target THEN target WHEN np < 10 AND total >= 10 THEN 10 ELSE np END""",
)
def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.representative(t.universe(spark, sf_dir), _LIMITS).select("symbol", "sector", "symbol_rank")


@query(
    "j04_random_pick",
    f"{_UNI} SELECT symbol, sector FROM universe ORDER BY md5('42|' || CAST(symbol AS VARCHAR)), symbol LIMIT 20",
)
def random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_pick(t.universe(spark, sf_dir), 20, 42).select("symbol", "sector")


_FIT = "CASE WHEN market_cap > 0 THEN greatest(0.0, 1 - abs(log10(market_cap) - (10.6 + 0.15)) / 1.5) ELSE 0.5 END + 0.15 + 0.4"


@query("j07_fit_scores", f"{_UNI} SELECT symbol, {r(_FIT, 'fit')} FROM universe")
def fit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = sampling.fit_score("trend", "trending_up", ("trending_up",))
    return rounded(t.universe(spark, sf_dir).select("symbol", fit.alias("fit")))


def _regime_fit_sql(where: str) -> str:
    return f"""{_UNI}, a AS (SELECT *, {_FIT} AS fit FROM universe WHERE {where}),
    w AS (SELECT sector, greatest(0.1, count(*) * (avg(fit) + 1 + 0.15)) AS wt FROM a GROUP BY sector),
    b AS (SELECT a.*, row_number() OVER (PARTITION BY a.sector ORDER BY fit DESC, symbol) - 1 AS pos, wt, (SELECT sum(wt) FROM w) AS wall,
      greatest(10, least(40, (SELECT count(*) FROM a))) AS target, (SELECT count(*) FROM a) AS total FROM a JOIN w ON w.sector = a.sector),
    c AS (SELECT *, pos < greatest(1, CAST(round_even(wt / wall * target, 0) AS INT)) AS picked FROM b),
    d AS (SELECT *, row_number() OVER (ORDER BY picked DESC, fit DESC, symbol) AS rk, count(*) FILTER (picked) OVER () AS np FROM c)
    SELECT symbol, sector, {r('fit', 'fit')} FROM d
    WHERE rk <= CASE WHEN np > target THEN target WHEN np < 10 AND total >= 10 THEN 10 ELSE np END"""


@query("j06_regime_fit_sample", _regime_fit_sql("true"))
def regime_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = sampling.fit_score("trend", "trending_up", ("trending_up",))
    got = sampling.regime_fit(t.universe(spark, sf_dir), fit, _LIMITS)
    return rounded(got.select("symbol", "sector", "fit"))


@query("b04_j05_strategy_scoped_sample", _regime_fit_sql("market_cap >= 15000000 AND sector <> 'CHINA'"))
def scoped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = t.universe(spark, sf_dir).withColumn("pe_ttm", F.lit(None).cast("double"))
    filters = [("market_cap", ">=", 15_000_000), ("pe_ttm", "<", 30.0), ("sector", "!=", "CHINA")]
    fit = sampling.fit_score("trend", "trending_up", ("trending_up",))
    got = sampling.strategy_scoped(u, filters, fit=fit, limits=_LIMITS)
    return rounded(got.select("symbol", "sector", "fit"))


# ── lessons derived from the order tables ────────────────────────────────────

TARGETS = (
    "entry.conditions[indicator=rsi_14].value",
    "entry.guards[indicator=momentum_10d].value",
    "exit.stop_loss.value",
    "exit.take_profit.value",
    "exit.max_holding_days",
    "universe.filters",
    "entry.logic",
)
PROBLEMS = ("low win rate in range markets", "drawdown too deep", "too few signals", "train val gap is wide", "profit ratio weak")
CHANGES = ("tighten_filter", "loosen_filter", "adjust_exit", "add_condition")


def _pick_sql(values: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({n} % {len(values)} AS INT) + 1]"


LESSONS_SQL = f"""
lessons AS (SELECT 'fam_' || o_orderpriority AS strategy_family, 'fam_' || o_orderpriority || '_v' || (o_custkey % 9) AS strategy_id,
  CAST(o_orderkey % 8 + 1 AS INT) AS round_num, {_pick_sql(CHANGES, 'o_custkey')} AS change_type, {_pick_sql(TARGETS, 'o_orderkey')} AS target,
  CAST(CASE WHEN o_orderkey % 7 = 4 THEN CAST(o_custkey % 12 + 2 AS VARCHAR) ELSE CAST(CAST(o_custkey % 30 AS INT) / 1000 AS VARCHAR) END AS VARCHAR) AS to_value,
  'because of ' || o_orderstatus || (o_custkey % 100) AS reason, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS score_before,
  CAST(o_orderkey % 100 + o_custkey % 21 - 10 AS DOUBLE) / 100 AS score_after, [{_pick_sql(PROBLEMS, 'o_orderkey')}, {_pick_sql(PROBLEMS, 'o_custkey')}] AS failure_patterns,
  date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 8640000000 + o_orderkey % 100000 AS created_at, CASE WHEN o_orderkey % 50 = 0 THEN 'test' ELSE 'llm' END AS source FROM orders),
le AS (SELECT *, score_after - score_before AS score_delta, score_after > score_before AS worked FROM lessons)"""
LE = f"WITH {LESSONS_SQL}"


def lesson_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as change outcomes: priority is the family, the key the round."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pick(values: tuple[str, ...], n) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))

    small = ((c % 30).cast("int") / 1000).cast("string")
    df = t.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("fam_"), "o_orderpriority").alias("strategy_family"),
        F.concat(F.lit("fam_"), "o_orderpriority", F.lit("_v"), (c % 9).cast("string")).alias("strategy_id"),
        (k % 8 + 1).cast("int").alias("round_num"),
        pick(CHANGES, c).alias("change_type"),
        pick(TARGETS, k).alias("target"),
        F.when(k % 7 == 4, (c % 12 + 2).cast("string")).otherwise(small).alias("to_value"),
        F.concat(F.lit("because of "), "o_orderstatus", (c % 100).cast("string")).alias("reason"),
        ((k % 100).cast("double") / 100).alias("score_before"),
        ((k % 100 + c % 21 - 10).cast("double") / 100).alias("score_after"),
        F.array(pick(PROBLEMS, k), pick(PROBLEMS, c)).alias("failure_patterns"),
        (F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")) * 8640000000 + k % 100000).alias("created_at"),
        F.when(k % 50 == 0, "test").otherwise("llm").alias("source"),
    )
    df = df.withColumn("score_delta", F.col("score_after") - F.col("score_before"))
    return df.withColumn("worked", F.col("score_after") > F.col("score_before"))


FAMILY = "fam_1-URGENT"
_REAL = "coalesce(source, '') NOT IN ('test', 'fixture') AND strategy_id NOT LIKE 'test\\_%' ESCAPE '\\'"


@query(
    "b15_j12_lesson_query",
    f"""{LE} SELECT strategy_id, round_num, change_type, target, created_at, {r('score_delta', 'score_delta')} FROM le
    WHERE strategy_family = '{FAMILY}' AND change_type IN ('adjust_exit', 'add_condition') AND worked AND {_REAL} ORDER BY created_at DESC LIMIT 25""",
)
def lesson_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lessons.lesson_query(
        lesson_table(spark, sf_dir),
        family=FAMILY,
        change_types=["adjust_exit", "add_condition"],
        only_worked=True,
        exclude_tests=True,
        limit=25,
    )
    return rounded(got.select("strategy_id", "round_num", "change_type", "target", "created_at", "score_delta"))


_RATES = "SELECT change_type, count(*) AS total, count(*) FILTER (worked) AS succeeded, avg(CAST(worked AS INT)) AS rate FROM le"


@query("j13_success_rates", f"{LE} SELECT change_type, total, succeeded, {r('rate', 'rate')} FROM ({_RATES} GROUP BY change_type)")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lessons.success_rates(lesson_table(spark, sf_dir)))


_VKEY = r"""CASE WHEN regexp_full_match(to_value, '-?[0-9]+') OR to_value IN ('true', 'false') OR TRY_CAST(to_value AS DOUBLE) IS NULL THEN to_value
  ELSE CAST(round(CAST(to_value AS DOUBLE), 2) AS VARCHAR) END"""
_FAILED = f"""{LE}, rc AS (SELECT *, row_number() OVER (PARTITION BY strategy_family ORDER BY created_at DESC) AS n FROM le),
fs AS (SELECT strategy_family, change_type, trim(target) AS target, {_VKEY} AS value_key, count(*) FILTER (NOT worked) AS failures, count(*) FILTER (worked) AS ok
  FROM rc GROUP BY ALL HAVING count(*) FILTER (NOT worked) >= 2 AND count(*) FILTER (worked) = 0)"""


@query("j14_failed_signatures", f"{_FAILED} SELECT strategy_family, change_type, target, value_key, failures FROM fs")
def failed_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lessons.failed_signatures(lesson_table(spark, sf_dir))


@query(
    "c12_drop_failed_changes",
    f"""{_FAILED} SELECT le.strategy_family, strategy_id, round_num, change_type, target, to_value, created_at FROM le
    WHERE NOT EXISTS (SELECT 1 FROM fs WHERE fs.strategy_family = le.strategy_family AND fs.change_type = le.change_type AND fs.target = trim(le.target)
      AND fs.value_key = {_VKEY.replace('to_value', 'le.to_value')})""",
)
def drop_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    le = lesson_table(spark, sf_dir)
    got = lessons.drop_failed_changes(le, lessons.failed_signatures(le))
    return got.select("strategy_family", "strategy_id", "round_num", "change_type", "target", "to_value", "created_at")


@query(
    "c13_j25_padded_lessons",
    f"""{LE}, own AS (SELECT strategy_id, round_num, created_at, 0 AS part FROM le WHERE strategy_family = '{FAMILY}' ORDER BY created_at DESC LIMIT 10),
    sp AS (SELECT strategy_id, round_num, created_at, 1 AS part FROM le WHERE worked ORDER BY created_at DESC LIMIT (SELECT 10 - count(*) FROM own)),
    al AS (SELECT * FROM own UNION ALL SELECT * FROM sp WHERE (strategy_id, round_num) NOT IN (SELECT (strategy_id, round_num) FROM own)),
    rk AS (SELECT *, row_number() OVER (ORDER BY part, created_at DESC) AS pos FROM al),
    kp AS (SELECT *, greatest(1, count(*) OVER () // 2) AS half FROM rk WHERE pos <= 10)
    SELECT strategy_id, round_num, created_at, pos, CASE WHEN pos <= half THEN 'RECENT' ELSE 'OLDER' END AS recency FROM kp""",
)
def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lessons.padded_lessons(lesson_table(spark, sf_dir), FAMILY)
    return got.select("strategy_id", "round_num", "created_at", "pos", "recency")


@query(
    "j15_lesson_records",
    f"""{LE}, oc AS (SELECT *, (score_after - score_before) / count(*) OVER (PARTITION BY strategy_id, round_num) AS d FROM le)
    SELECT strategy_id, round_num, created_at, {r('d', 'score_delta')}, d > 0 AS worked FROM oc""",
)
def lesson_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lessons.lesson_records(lesson_table(spark, sf_dir).drop("score_delta", "worked"))
    return rounded(got.select("strategy_id", "round_num", "created_at", "score_delta", "worked"))


@query(
    "j16_cross_strategy_memory",
    f"""{LE}, rc AS (SELECT * FROM le WHERE {_REAL}),
    g AS (SELECT change_type, target, count(*) AS total, count(*) FILTER (worked) AS succeeded, count(DISTINCT strategy_family) AS families FROM rc
      WHERE strategy_family <> '{FAMILY}' GROUP BY ALL HAVING count(*) FILTER (worked) > 0),
    ea AS (SELECT change_type, target, strategy_id, max(created_at) AS seen FROM rc WHERE strategy_family <> '{FAMILY}' GROUP BY ALL),
    ex AS (SELECT *, row_number() OVER (PARTITION BY change_type, target ORDER BY seen DESC, strategy_id) AS k FROM ea),
    es AS (SELECT change_type, target, list(strategy_id ORDER BY k) AS examples FROM ex WHERE k <= 2 GROUP BY ALL)
    SELECT change_type, target, total, succeeded, families, {r('succeeded / total', 'rate')}, examples FROM g JOIN es USING (change_type, target) ORDER BY g.succeeded DESC, g.total DESC, change_type, target LIMIT 2""",
)
def cross_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lessons.cross_strategy_memory(lesson_table(spark, sf_dir), FAMILY))


_RANKED_TYPES = f"""{LE}, rt AS (SELECT strategy_family, change_type, count(*) AS total, count(*) FILTER (worked) AS succeeded, avg(CAST(worked AS INT)) AS rate FROM le WHERE {_REAL} GROUP BY ALL),
rw AS (SELECT *, rate * least(1.0, total / 5) AS weight FROM rt),
rp AS (SELECT *, row_number() OVER (PARTITION BY strategy_family ORDER BY weight DESC, change_type) AS position, rate < 0.2 AND total >= 3 AS avoid FROM rw)"""


@query(
    "j17_ranked_change_types",
    f"{_RANKED_TYPES} SELECT strategy_family, change_type, total, succeeded, {r('rate', 'rate')}, {r('weight', 'weight')}, position, avoid FROM rp",
)
def ranked_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    le = lesson_table(spark, sf_dir).where(lessons.real_sources())
    return rounded(lessons.ranked_change_types(le, ["strategy_family"]))


def _cat_sql(logic: bool) -> str:
    extra = " WHEN contains(target, 'entry.logic') THEN 'entry_logic'" if logic else ""
    return f"""CASE WHEN contains(target, 'entry.triggers') OR contains(target, 'entry.conditions') THEN 'entry_condition'
  WHEN contains(target, 'entry.guards') OR contains(target, 'entry.filters') THEN 'entry_filter'{extra} WHEN contains(target, 'stop_loss') THEN 'stop_loss'
  WHEN contains(target, 'take_profit') THEN 'take_profit' WHEN contains(target, 'max_holding') THEN 'holding_period' WHEN contains(target, 'universe') THEN 'universe' ELSE 'other' END"""


@query(
    "j18_top_success_patterns",
    f"""{LE}, rc AS (SELECT * FROM le WHERE worked AND {_REAL})
    SELECT change_type || '→' || {_cat_sql(False)} AS pattern, count(*) AS n FROM rc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def top_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lessons.top_success_patterns(lesson_table(spark, sf_dir))


_EFFECT = """
ef AS (SELECT strategy_family, count(*) AS n, coalesce(avg(score_delta) FILTER (round_num <= 2), 0) AS e, coalesce(avg(score_delta) FILTER (round_num > 2), 0) AS l,
  coalesce(max(round_num) FILTER (worked AND score_delta > 0.01), 0) AS li FROM src GROUP BY strategy_family),
ei AS (SELECT *, CASE WHEN n < 5 THEN 1.0 WHEN e > l AND l > 0 THEN 1.3 WHEN l > e THEN 0.8 ELSE 1.0 END AS intensity,
  CASE WHEN n < 3 THEN 5 ELSE least(10, greatest(3, li + 2)) END AS rounds FROM ef)"""


@query(
    "j19_round_effect",
    f"{LE}, src AS (SELECT * FROM le), {_EFFECT} SELECT strategy_family, n, {r('e', 'early_avg')}, {r('l', 'late_avg')}, {r('intensity', 'intensity')} FROM ei",
)
def round_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lessons.round_effect(lesson_table(spark, sf_dir), ["strategy_family"]))


@query(
    "j20_convergence",
    f"{LE}, src AS (SELECT * FROM le), {_EFFECT} SELECT strategy_family, n, li AS last_improvement, rounds AS estimated_rounds FROM ei",
)
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lessons.convergence(lesson_table(spark, sf_dir), ["strategy_family"])


@query(
    "j26_search_profile",
    f"""{_RANKED_TYPES}, src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy_family ORDER BY created_at DESC) AS k FROM le WHERE {_REAL})), {_EFFECT},
    ev AS (SELECT strategy_family, count(*) AS sc, avg(CAST(worked AS INT)) AS wr FROM le GROUP BY strategy_family),
    lk AS (SELECT strategy_family, string_agg(change_type, ',' ORDER BY position) FILTER (position <= 3) AS preferred FROM rp GROUP BY strategy_family)
    SELECT strategy_family, preferred, {r('CASE WHEN sc < 15 THEN greatest(1.5, intensity) WHEN wr > 0.6 AND sc > 50 THEN least(0.7, intensity) ELSE intensity END', 'intensity')},
    CASE WHEN sc < 15 THEN 'hybrid' WHEN wr > 0.6 AND sc > 50 THEN 'param_search' ELSE 'llm' END AS method,
    CASE WHEN sc < 15 OR (wr > 0.6 AND sc > 50) THEN 2 ELSE 3 END AS max_changes, rounds AS estimated_rounds
    FROM lk JOIN ei USING (strategy_family) JOIN ev USING (strategy_family)""",
)
def search_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    le = lesson_table(spark, sf_dir)
    evals = le.groupBy("strategy_family").agg(
        F.count("*").alias("signal_count"), F.avg(F.col("worked").cast("double")).alias("win_rate")
    )
    got = lessons.search_profile(le, evals)
    return rounded(
        got.select(
            "strategy_family", F.concat_ws(",", "preferred").alias("preferred"), "intensity", "method", "max_changes", "estimated_rounds"
        )
    )


_MINED = f"""{LE}, rc AS (SELECT * FROM le WHERE worked AND {_REAL}),
ht AS (SELECT lower(unnest(failure_patterns)) AS fp, change_type AS action, {_cat_sql(True)} AS tc, reason FROM rc),
hc AS (SELECT CASE WHEN contains(fp, 'win') AND contains(fp, 'rate') THEN 'low_win_rate' WHEN contains(fp, 'drawdown') THEN 'high_drawdown'
   WHEN contains(fp, 'overfit') OR (contains(fp, 'train') AND (contains(fp, 'val') OR contains(fp, 'gap'))) THEN 'overfit'
   WHEN contains(fp, 'profit') OR contains(fp, 'p/l') THEN 'low_pl_ratio' WHEN contains(fp, 'signal') AND contains(fp, 'few') THEN 'low_signals' END AS category, action, tc, reason FROM ht),
cn AS (SELECT category, action, tc, count(*) AS n, max(row(length(reason), reason)) AS best FROM hc WHERE category IS NOT NULL GROUP BY ALL),
rn AS (SELECT *, sum(n) OVER (PARTITION BY category) AS total, row_number() OVER (PARTITION BY category ORDER BY n DESC, action, tc) AS step FROM cn),
pb AS (SELECT category, string_agg(action || ':' || tc, '|' ORDER BY step) AS steps, CAST(max(total) AS BIGINT) AS times_applied FROM rn WHERE total >= 3 AND step <= 3 GROUP BY category)"""


@query(
    "j21_mined_playbooks",
    f"""{_MINED} SELECT 'auto_' || category || '_' || substr(sha256(steps), 1, 8) AS playbook_id, category AS problem_category, steps, times_applied,
    {r('times_applied / (times_applied + 1)', 'success_rate')} FROM pb""",
)
def mined_playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lessons.mine_playbooks(lesson_table(spark, sf_dir))
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["action"], s["target"])), "|")
    return rounded(got.select("playbook_id", "problem_category", steps.alias("steps"), "times_applied", "success_rate"))


@query(
    "j22_playbook_match",
    f"""{_MINED} SELECT category AS problem_category, {r('times_applied / (times_applied + 1)', 'success_rate')} FROM pb WHERE category = 'low_win_rate' LIMIT 5""",
)
def playbook_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lessons.match_playbooks(lessons.mine_playbooks(lesson_table(spark, sf_dir)), "low_win_rate")
    return rounded(got.select("problem_category", "success_rate"))


@query(
    "j22_j24_outcome_rates",
    f"{LE} SELECT target, count(*) AS times_used, count(*) FILTER (worked) AS times_succeeded, {r('avg(CAST(worked AS INT))', 'success_rate')} FROM le GROUP BY target",
)
def outcome_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lesson_table(spark, sf_dir).withColumn("succeeded", F.col("worked"))
    return rounded(lessons.outcome_rates(events, "target"))


@query(
    "j28_event_feed",
    f"{LE} SELECT strategy_id, change_type, round_num, created_at FROM le WHERE change_type = 'adjust_exit' AND round_num = 3 ORDER BY created_at DESC LIMIT 50",
)
def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = lesson_table(spark, sf_dir).withColumn("event_type", F.col("change_type"))
    got = lessons.event_feed(feed, event_type="adjust_exit", round_num=3)
    return got.select("strategy_id", "change_type", "round_num", "created_at")


# ── evaluation logs ──────────────────────────────────────────────────────────

EVLOG_SQL = """
evlog AS (SELECT 'e' || (o_custkey * 2 + o_orderkey % 2) AS id, 'fam_' || o_orderpriority || '_v' || (o_custkey % 9) AS strategy_id, 'fam_' || o_orderpriority AS family_id,
  CAST(floor(o_totalprice) AS BIGINT) % 1000 / 1000.0 AS confidence_score, o_orderkey % 90 AS signal_count, (o_custkey % 70) / 100.0 AS win_rate,
  date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 8640000000 + o_orderkey % 100000 AS created_at, 'j' || o_orderkey AS json_content FROM orders),
evs AS (SELECT id, arg_min(strategy_id, created_at) AS strategy_id, arg_min(family_id, created_at) AS family_id, arg_max(confidence_score, created_at) AS confidence_score,
  arg_min(signal_count, created_at) AS signal_count, arg_min(win_rate, created_at) AS win_rate, min(created_at) AS created_at, arg_max(json_content, created_at) AS json_content FROM evlog GROUP BY id)"""
EV = f"WITH {EVLOG_SQL}"


def evaluation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("e"), (c * 2 + k % 2).cast("string")).alias("id"),
        F.concat(F.lit("fam_"), "o_orderpriority", F.lit("_v"), (c % 9).cast("string")).alias("strategy_id"),
        F.concat(F.lit("fam_"), "o_orderpriority").alias("family_id"),
        (F.floor("o_totalprice").cast("long") % 1000 / 1000.0).alias("confidence_score"),
        (k % 90).alias("signal_count"),
        ((c % 70) / 100.0).alias("win_rate"),
        (F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")) * 8640000000 + k % 100000).alias("created_at"),
        F.concat(F.lit("j"), k.cast("string")).alias("json_content"),
    )


def evaluation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest_evaluations(evaluation_log(spark, sf_dir))


@query(
    "a19_evaluation_upsert",
    f"{EV} SELECT id, strategy_id, {r('confidence_score', 'confidence_score')}, signal_count, created_at, json_content FROM evs",
)
def evaluation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluation_table(spark, sf_dir)
    return rounded(got.select("id", "strategy_id", "confidence_score", "signal_count", "created_at", "json_content"))


@query(
    "a19_evaluation_store",
    f"{EV} SELECT id, strategy_id, {r('confidence_score', 'confidence_score')}, signal_count, created_at, json_content FROM evs",
)
def evaluation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert as a store: an older part folded into the base, a newer one still in the delta."""
    log, path = evaluation_log(spark, sf_dir), shared_path(spark)
    older = F.col("created_at") < 9500 * 8640000000
    ranking.append_evaluations(log.where(older), path)
    ranking.compact_evaluations(spark, path)
    ranking.append_evaluations(log.where(~older), path)
    got = ranking.read_evaluations(spark, path)
    return rounded(got.select("id", "strategy_id", "confidence_score", "signal_count", "created_at", "json_content"))


_BOARD = f"""{EV}, st AS (SELECT DISTINCT strategy_id, family_id FROM evs),
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY confidence_score DESC, id DESC) AS k FROM evs WHERE signal_count >= 30) WHERE k = 1)"""


@query(
    "c09_i12_leaderboard",
    f"{_BOARD} SELECT bb.strategy_id, bb.id, {r('bb.confidence_score', 'confidence_score')}, signal_count FROM bb JOIN st USING (strategy_id) ORDER BY bb.confidence_score DESC, bb.strategy_id LIMIT 20",
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = evaluation_table(spark, sf_dir)
    names = evals.select("strategy_id").distinct().withColumn("listed", F.lit(True))
    got = ranking.leaderboard(evals, names)
    return rounded(got.select("strategy_id", "id", "confidence_score", "signal_count"))


@query(
    "i13_comparison",
    f"""{EV}, nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY created_at DESC, id DESC) AS k FROM evs) WHERE k = 1),
    wd AS (SELECT strategy_id, CAST(confidence_score AS DOUBLE) AS confidence_score, CAST(win_rate AS DOUBLE) AS win_rate, CAST(signal_count AS DOUBLE) AS signal_count FROM nw),
    up AS (UNPIVOT wd ON confidence_score, win_rate, signal_count INTO NAME metric VALUE value) SELECT strategy_id, metric, {r('value', 'value')} FROM up""",
)
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.comparison(evaluation_table(spark, sf_dir), ["confidence_score", "win_rate", "signal_count"]))


@query(
    "i14_family_champions",
    f"{EV} SELECT family_id, {r('max(confidence_score)', 'best_score')}, arg_max(strategy_id, row(confidence_score, strategy_id)) AS champion_id FROM evs GROUP BY family_id",
)
def family_champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.family_champions(evaluation_table(spark, sf_dir)))


@query(
    "j27_evaluation_history",
    f"{EV} SELECT id, created_at, {r('confidence_score', 'confidence_score')} FROM evs WHERE strategy_id = 'fam_2-HIGH_v3'",
)
def evaluation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranking.history(evaluation_table(spark, sf_dir), "fam_2-HIGH_v3")
    return rounded(got.select("id", "created_at", "confidence_score"))


_ROUNDS = f"""{LE}, rd AS (SELECT strategy_id, round_num, max(score_after) AS confidence_score, bool_or(worked) AS improved FROM le GROUP BY ALL)"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lesson_table(spark, sf_dir).groupBy("strategy_id", "round_num").agg(
        F.max("score_after").alias("confidence_score"), F.bool_or("worked").alias("improved")
    )


@query(
    "i15_round_velocity",
    f"{_ROUNDS} SELECT strategy_id, round_num, {r('confidence_score - lag(confidence_score) OVER (PARTITION BY strategy_id ORDER BY round_num)', 'velocity')} FROM rd",
)
def round_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranking.round_progress(rounds(spark, sf_dir), ["strategy_id"])
    return rounded(got.select("strategy_id", "round_num", "velocity"))


@query(
    "i15_round_summary",
    f"{_ROUNDS} SELECT strategy_id, {r('max(confidence_score) - arg_min(confidence_score, round_num)', 'improvement')}, {r('avg(CAST(improved AS INT))', 'efficiency')}, count(*) AS rounds FROM rd GROUP BY strategy_id",
)
def round_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.round_summary(rounds(spark, sf_dir), ["strategy_id"]))


@query(
    "i16_step_outcomes",
    f"""{_ROUNDS}, sx AS (SELECT strategy_id, round_num AS step, confidence_score AS score_before, max(confidence_score) OVER (PARTITION BY strategy_id) AS best FROM rd),
    sy AS (SELECT *, coalesce(lead(score_before) OVER (PARTITION BY strategy_id ORDER BY step), best) AS score_after FROM sx)
    SELECT strategy_id, step, {r('score_after', 'score_after')}, {r('score_after - score_before', 'score_delta')}, score_after - score_before > 0 AS improved FROM sy""",
)
def step_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rd = rounds(spark, sf_dir)
    best = rd.groupBy("strategy_id").agg(F.max("confidence_score").alias("best_score"))
    steps = rd.join(best, "strategy_id").select(
        "strategy_id",
        F.col("round_num").alias("step"),
        F.col("confidence_score").alias("score_before"),
        F.lit(0.5).alias("win_rate_before"),
        "best_score",
    )
    got = ranking.step_outcomes(steps, ["strategy_id"])
    return rounded(got.select("strategy_id", "step", "score_after", "score_delta", "improved"))


@query(
    "i17_champion_spread",
    f"""{EV}, g AS (SELECT family_id AS group_id, avg(confidence_score) AS champion_score FROM evs GROUP BY family_id)
    SELECT {r('least(1.0, stddev_samp(champion_score) / avg(champion_score))', 'diversity')}, arg_max(group_id, champion_score) AS best_group FROM g WHERE champion_score > 0""",
)
def champion_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = evaluation_table(spark, sf_dir).groupBy(F.col("family_id").alias("group_id")).agg(
        F.avg("confidence_score").alias("champion_score")
    )
    return rounded(ranking.champion_spread(groups))


# ── strategies: lineage, differences, fingerprints, patterns ─────────────────


@query(
    "c14_lineage",
    """WITH RECURSIVE nodes AS (SELECT p_brand AS family, p_partkey AS id, p_partkey - p_size AS parent_id FROM part),
    lk AS (SELECT n.family, n.id, p.id AS up FROM nodes n LEFT JOIN nodes p ON p.family = n.family AND p.id = n.parent_id),
    tree AS (SELECT family, id, id AS root_id, CAST(0 AS BIGINT) AS depth FROM lk WHERE up IS NULL
      UNION ALL SELECT lk.family, lk.id, tree.root_id, tree.depth + 1 FROM lk JOIN tree ON lk.family = tree.family AND lk.up = tree.id)
    SELECT family, id, root_id, depth FROM tree""",
)
def lineage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_size")).alias("parent_id")
    )
    return lineage.lineage(nodes).select("family", "id", "root_id", "depth")


@query(
    "b14_spec_diff",
    """WITH fields AS (SELECT p_brand AS id, 'exit.' || p_type || '.' || p_size AS path, CAST(CAST(round(max(p_retailprice)) AS BIGINT) AS VARCHAR) AS value FROM part GROUP BY ALL),
    a AS (SELECT path, value FROM fields WHERE id = 'Brand#11'), b AS (SELECT path, value FROM fields WHERE id = 'Brand#12')
    SELECT coalesce(a.path, b.path) AS path, coalesce(a.value, '—') AS left_value, coalesce(b.value, '—') AS right_value
    FROM a FULL JOIN b ON a.path = b.path WHERE a.value IS DISTINCT FROM b.value""",
)
def spec_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (
        t.table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("id"), F.concat(F.lit("exit."), "p_type", F.lit("."), F.col("p_size").cast("string")).alias("path"))
        .agg(F.round(F.max("p_retailprice")).cast("long").cast("string").alias("value"))
    )
    return lineage.spec_diff(fields, "Brand#11", "Brand#12")


_PRINTS = """WITH ru AS (SELECT l_orderkey AS id, list_sort(list_distinct(list('ec:rule' || l_linenumber || '>' || CAST(l_quantity AS INT) % 3))) AS parts FROM lineitem GROUP BY l_orderkey),
fp AS (SELECT id, substr(sha256(array_to_string(parts, '|')), 1, 16) AS fingerprint FROM ru)"""


@query("b13_fingerprint_dedup", f"{_PRINTS} SELECT fingerprint, min(id) AS id FROM fp GROUP BY fingerprint")
def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.concat(F.lit("ec:rule"), F.col("l_linenumber").cast("string"), F.lit(">"), (F.col("l_quantity").cast("int") % 3).cast("string"))
    specs = t.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(rule).alias("parts"))
    return lineage.unique_strategies(lineage.with_fingerprint(specs)).select("fingerprint", "id")


_PATTERNS = f"""{EV}, st AS (SELECT strategy_id, list_distinct(list(CASE WHEN signal_count % 3 = 0 THEN 'rsi_14' WHEN signal_count % 3 = 1 THEN 'atr' ELSE 'ma20_slope' END)) AS names FROM evs GROUP BY strategy_id),
gd AS (SELECT evs.strategy_id, id, confidence_score, signal_count, list_sort(names) AS names FROM evs JOIN st USING (strategy_id) WHERE signal_count >= 20 AND confidence_score >= 0.3),
pt AS (SELECT 'exit_' || strategy_id AS pattern_id, 'exit_config' AS pattern_type, 'pct:0.05' AS content, * FROM gd
  UNION ALL SELECT 'indicators_' || strategy_id, 'indicator_set', array_to_string(names, ','), * FROM gd WHERE len(names) >= 2
  UNION ALL SELECT 'entry_' || strategy_id, 'entry_combo', array_to_string(list_transform(names, lambda n: n || ' > 1'), '; '), * FROM gd WHERE len(names) >= 2)"""


def pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = evaluation_table(spark, sf_dir)
    n = F.col("signal_count") % 3
    name = F.when(n == 0, "rsi_14").when(n == 1, "atr").otherwise("ma20_slope")
    specs = evals.groupBy("strategy_id").agg(F.array_sort(F.collect_set(name)).alias("names"))
    rules = F.transform("names", lambda i: F.struct(i.alias("indicator"), F.lit(">").alias("op"), F.lit("1").alias("value")))
    specs = specs.select("strategy_id", rules.alias("rules"), F.lit("pct:0.05").alias("exit_config"))
    return lessons.extract_patterns(specs, evals)


@query("j23_extracted_patterns", f"{_PATTERNS} SELECT pattern_id, pattern_type, content, {r('confidence_score', 'confidence_score')}, signal_count FROM pt")
def extracted_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pattern_table(spark, sf_dir)
    return rounded(got.select("pattern_id", "pattern_type", "content", "confidence_score", "signal_count"))


@query(
    "j24_best_patterns",
    f"""{_PATTERNS} SELECT pattern_id, {r('confidence_score', 'confidence_score')} FROM pt WHERE pattern_type = 'exit_config' AND starts_with(strategy_id, 'fam_2-HIGH_v')
    ORDER BY pt.confidence_score DESC, pattern_id LIMIT 10""",
)
def best_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lessons.best_patterns(pattern_table(spark, sf_dir), pattern_type="exit_config", family="fam_2-HIGH", exclude_tests=True)
    return rounded(got.select("pattern_id", "confidence_score"))


@query(
    "j16_borrowed_patterns",
    f"""{_PATTERNS}, us AS (SELECT strategy_id, count(*) AS times_used, count(*) FILTER (confidence_score > 0.5) AS hits FROM evlog GROUP BY strategy_id)
    SELECT pattern_id, pattern_type, pt.strategy_id AS source_strategy, 'Borrowed [' || pattern_type || '] from `' || pt.strategy_id || '`: ' || content || '; '
      || CASE WHEN times_used > 100 THEN 'used ' || times_used || 'x with ' || CAST(round(CAST(round(hits / times_used, 4) AS DECIMAL(10, 4)) * 100, 0) AS INT) || '% success'
         ELSE 'source score ' || CAST(round(CAST(confidence_score AS DECIMAL(10, 4)) * 100, 0) AS INT) || '%, win rate 50%' END || '.' AS text
    FROM pt LEFT JOIN us ON us.strategy_id = pt.strategy_id WHERE regexp_replace(pt.strategy_id, '_v[0-9]+$', '') <> 'fam_2-HIGH' ORDER BY confidence_score DESC, pattern_id LIMIT 2""",
)
def borrowed_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best patterns of other families, with how often they were used where that is known."""
    used = evaluation_log(spark, sf_dir).groupBy(F.col("strategy_id").alias("source_strategy")).agg(
        F.count("*").alias("times_used"), F.round(F.avg((F.col("confidence_score") > 0.5).cast("double")), 4).alias("success_rate")
    )
    known = pattern_table(spark, sf_dir).join(used.where("times_used > 100"), "source_strategy", "left").withColumn("win_rate", F.lit(0.5))
    return lessons.borrowed_patterns(known, "fam_2-HIGH").select("pattern_id", "pattern_type", "source_strategy", "text")


# ── exports ──────────────────────────────────────────────────────────────────

_STEPS = f"""{LE}, sp AS (SELECT strategy_id AS trajectory_id, strategy_family, round_num, strategy_id, score_before, score_after, score_delta, worked AS improved, failure_patterns,
  change_type, target, to_value, reason, created_at FROM le)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    le = lesson_table(spark, sf_dir)
    return le.select(
        F.col("strategy_id").alias("trajectory_id"),
        "strategy_family",
        "round_num",
        "strategy_id",
        "score_before",
        "score_after",
        "score_delta",
        F.col("worked").alias("improved"),
        "failure_patterns",
        F.lit(0.5).alias("win_rate_before"),
        F.lit(0.5).alias("win_rate_after"),
        F.lit(30).alias("signal_count_before"),
        F.lit(30).alias("signal_count_after"),
        F.col("reason").alias("diagnosis"),
        F.lit("").alias("hypothesis"),
        F.lit("").alias("expected_outcome"),
        F.array(F.struct("change_type", "target", F.lit("?").alias("from_value"), "to_value")).alias("changes"),
        F.lit("llm").alias("method"),
        "created_at",
    )


@query(
    "a17_step_export",
    f"""{_STEPS} SELECT trajectory_id, round_num AS round, {r('score_before', 'score')}, {r('score_delta', 'score_delta')}, improved, target, array_to_string(failure_patterns, '; ') AS problems FROM sp""",
)
def step_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, path = export.step_records(steps(spark, sf_dir)), shared_path(spark)
    export.write_json(records, path)
    back = spark.read.schema(records.schema).json(path)
    return rounded(
        back.select(
            "trajectory_id",
            "round",
            F.col("input.score").alias("score"),
            F.col("outcome.score_delta").alias("score_delta"),
            F.col("outcome.improved").alias("improved"),
            F.col("action.changes")[0]["target"].alias("target"),
            F.concat_ws("; ", "input.failure_patterns").alias("problems"),
        )
    )


def _one(x: str) -> str:
    return f"printf('%.1f%%', {x} * 100)"


@query(
    "a18_conversation_export",
    f"""{_STEPS} SELECT trajectory_id, round_num AS round, improved, 'Strategy: ' || strategy_id || chr(10) || 'Current score: ' || {_one('score_before')} || chr(10) || 'Win rate: 50.0%'
      || chr(10) || 'Signal count: 30' || chr(10) || 'Problems: ' || array_to_string(failure_patterns, '; ') || chr(10) || chr(10) || 'How should we improve this strategy?' AS human,
    'Diagnosis: ' || reason || chr(10) || chr(10) || 'Hypothesis: ' || chr(10) || 'Expected: ' || chr(10) || chr(10) || 'Proposed changes:' || chr(10)
      || '  - ' || change_type || ': ' || target || ' (? → ' || to_value || ')' || chr(10)
      || CASE WHEN round_num % 2 = 0 THEN chr(10) || 'Critic verdict: accept' || chr(10) ELSE '' END || CASE WHEN round_num % 3 = 0 THEN 'Playbook used: pb' || round_num || chr(10) ELSE '' END
      || CASE WHEN round_num % 4 = 0 THEN 'LLM telemetry: path=api, total_duration_ms=' || (round_num * 10) || ', calls=2' || chr(10) ELSE '' END
      || chr(10) || 'Result: ' || CASE WHEN improved THEN 'improved' ELSE 'no improvement' END || ' (score ' || {_one('score_before')} || ' → ' || {_one('score_after')}
      || ', delta=' || printf('%+.1f%%', score_delta * 100) || ')' AS gpt FROM sp""",
)
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("round_num")
    telemetry = F.struct(F.lit("api").alias("path"), (n * 10).alias("total_duration_ms"), F.array(F.lit("a"), F.lit("b")).alias("calls"))
    told = steps(spark, sf_dir).withColumns(
        {
            "critic_verdict": F.when(n % 2 == 0, "accept"),
            "playbook_used": F.when(n % 3 == 0, F.concat(F.lit("pb"), n.cast("string"))),
            "llm_telemetry": F.when(n % 4 == 0, telemetry),
        }
    )
    records, path = export.conversation_records(told), shared_path(spark)
    export.write_json(records, path)
    back = spark.read.schema(records.schema).json(path)
    return back.select(
        "metadata.trajectory_id",
        "metadata.round",
        "metadata.improved",
        F.col("conversations")[0]["value"].alias("human"),
        F.col("conversations")[1]["value"].alias("gpt"),
    )


@query(
    "c11_preference_sides",
    f"""{_STEPS}, bt AS (SELECT trajectory_id AS tid, count(*) FILTER (improved) AS g, count(*) FILTER (NOT improved) AS b FROM sp GROUP BY 1)
    SELECT trajectory_id, round_num, CASE WHEN improved THEN 'chosen' ELSE 'rejected' END AS side, reason AS diagnosis, {r('score_before', 'score_before')}, {r('score_after', 'score_after')},
    g AS chosen_steps, b AS rejected_steps FROM sp JOIN bt ON tid = trajectory_id WHERE g > 0 AND b > 0""",
)
def preference_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.preference_sides(steps(spark, sf_dir)).drop("strategy_id"))


@query(
    "a22_experiment_summary",
    f"""{LE} SELECT strategy_id AS strategy, change_type AS mode, {r('score_after - score_before', 'improvement')}, round_num AS rounds, source = 'test' AS failed FROM le""",
)
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    lesson_table(spark, sf_dir).select(
        F.col("strategy_id").alias("strategy"),
        F.col("change_type").alias("mode"),
        F.col("score_before").alias("initial_score"),
        F.col("score_after").alias("final_score"),
        F.col("round_num").alias("rounds"),
        F.when(F.col("source") == "test", "failed run").otherwise("").alias("error"),
    ).write.option("header", True).csv(path)
    got = export.read_experiments(spark, path)
    return rounded(got.select("strategy", "mode", "improvement", "rounds", "failed"))


@query("a23_evaluation_export", f"{EV} SELECT strategy_id, id, {r('confidence_score', 'confidence_score')}, signal_count FROM evs")
def evaluation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = evaluation_table(spark, sf_dir)
    docs, path = export.evaluation_records(evals), shared_path(spark)
    export.write_json(docs, path)
    back = spark.read.schema(docs.schema).json(path)
    return rounded(back.select("strategy_id", "evaluation.id", "evaluation.confidence_score", "evaluation.signal_count"))


@query("a08_snapshot_jsonl", f"{BARS} SELECT CAST(symbol AS VARCHAR) AS symbol, date, open, high, low, close, volume FROM bars")
def snapshot_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    t.bars(spark, sf_dir).withColumn("symbol", F.col("symbol").cast("string")).write.json(path)
    return src.read_snapshot(spark, path).select("symbol", "date", "open", "high", "low", "close", "volume")


@query("g25_family_and_complexity", f"{EV} SELECT DISTINCT strategy_id, regexp_replace(strategy_id, '_v[0-9]+$', '') AS family, CAST({BASE.complexity} AS DOUBLE) AS complexity FROM evs")
def family_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = evaluation_log(spark, sf_dir).select("strategy_id").distinct()
    return evals.select(
        "strategy_id", spec.family_id(F.col("strategy_id")).alias("family"), F.lit(BASE.complexity).alias("complexity")
    )
