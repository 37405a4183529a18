"""SQL counterpart of the trade operator, for the comparison run."""

from __future__ import annotations

from tapeloom.plans import tables as t
from tapeloom.plans.bar_queries import _SIMPLE, WIDE, W, lag, regime_sql

FLAG = f"({_SIMPLE['d01_d25_ma_above']['ma5_above_ma10']}) AND ({_SIMPLE['d04_d27_close_above_ma']['close_above_ma20']})"
ONE = "(VALUES (0, 0.10, 2.0, 10)) c(candidate_id, stop_v, target_v, hold)"
PCT_STOP = ("low <= p * (1 - stop_v)", "p * (1 - stop_v)")
RR_TARGET = ("high >= p + p * stop_v * target_v", "p + p * stop_v * target_v")

BASE = f"""{t.SQL_BARS},
x AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, close / pc - 1 AS ret
      FROM (SELECT *, {lag('close')} AS pc, {lag('open')} AS po FROM bars))"""

RICH = f"""{t.SQL_BARS}, {t.SQL_UNIVERSE}, {regime_sql('bars', 'PARTITION BY symbol', WIDE.volatility)},
x AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, close / pc - 1 AS ret
      FROM (SELECT rg.symbol, rg.date, open, high, low, close, volume, prev_close, idx, regime, sector, name,
                   lag(close) OVER (PARTITION BY rg.symbol ORDER BY rg.date) AS pc, lag(open) OVER (PARTITION BY rg.symbol ORDER BY rg.date) AS po
            FROM rg LEFT JOIN universe ON universe.symbol = rg.symbol))"""


def trades_sql(
    *,
    base: str = BASE,
    entry: str = FLAG,
    start: int = 30,
    cand: str = ONE,
    stop: tuple[str, str] = PCT_STOP,
    target: tuple[str, str] = RR_TARGET,
    timing: str = "next_open",
    trigger: str = "false",
    policy: str = "conservative",
    buy: str = "volume <> 0",
    sell: str = "volume <> 0",
    t_plus_1: bool = False,
    slip: float = 0.001,
    comm: float = 0.0003,
    columns: str = "",
    tags: str = "",
    gate: str = "true",
    reach: str = "hold + 1",
    entry_cand: str = "true",
    cand_columns: str = "",
    signal: str = "trig",
    source: str = "x",
) -> str:
    """CTE chain (without WITH) ending in ``taken``."""
    more = f", {columns}" if columns else ""
    tagged = f", {tags}" if tags else ""
    moving = f", {cand_columns}" if cand_columns else ""
    if timing == "close":
        at, price = "idx", "close"
    else:
        at, price = "coalesce(n_idx, idx)", "coalesce(n_open, open)"
    ok = "n_open >= high" if timing == "breakout_high" else "true"
    prefer = {"conservative": "false", "optimistic": "true", "close_first": "close >= p"}[policy]
    wait = "j > e" if t_plus_1 else "true"
    key = "candidate_id, symbol, s"
    return f"""{base},
f0 AS (SELECT *, ({entry}) AS flag, coalesce(({trigger}), false) AS trig, ({sell}) AS sellable{more} FROM {source}),
f1 AS (SELECT *, lead(idx) OVER ({W}) AS n_idx, lead(open) OVER ({W}) AS n_open, lead(low) OVER ({W}) AS n_low,
              lead(close) OVER ({W}) AS n_close, lead(date) OVER ({W}) AS n_date, max(idx) OVER (PARTITION BY symbol) AS last_idx,
              count(*) OVER (PARTITION BY symbol) AS n_bars FROM f0),
ent AS (SELECT candidate_id, stop_v, target_v, hold, symbol, idx AS s, date AS sd, high AS sh, last_idx, {at} AS e, {price} * {1 + slip} AS p,
               {'date' if timing == 'close' else 'coalesce(n_date, date)'} AS ed, {'low' if timing == 'close' else 'coalesce(n_low, low)'} AS e_low,
               {'close' if timing == 'close' else 'coalesce(n_close, close)'} AS e_close{tagged}{moving}
        FROM f1, {cand} WHERE flag AND n_bars >= 30 AND idx >= {start} AND {buy} AND {ok} AND {gate} AND {entry_cand}),
look AS (SELECT ent.*, b.idx AS j, b.date AS jd, b.high, b.low, b.close, b.trig, b.sellable,
                b.* EXCLUDE (symbol, date, open, high, low, close, volume, prev_close, idx, flag, trig, sellable, n_idx, n_open, n_low, n_close, n_date, last_idx, n_bars{', ' + tags if tags else ''}),
                max(CASE WHEN b.idx >= e THEN b.high END) OVER lk AS peak_e, max(CASE WHEN b.idx >= e + 1 THEN b.high END) OVER lk AS peak_1
         FROM ent JOIN f1 b ON b.symbol = ent.symbol AND b.idx > ent.s AND b.idx <= ent.s + {reach}
         WINDOW lk AS (PARTITION BY candidate_id, ent.symbol, s ORDER BY b.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
judged AS (SELECT *, coalesce({stop[0]}, false) AS st, coalesce({target[0]}, false) AS tg FROM look WHERE sellable AND {wait}),
called AS (SELECT *, CASE WHEN j - e >= hold THEN 'max_hold' WHEN tg AND (NOT st OR {prefer}) THEN 'take_profit'
                          WHEN st THEN 'stop_loss' WHEN {signal} THEN 'signal' END AS reason FROM judged),
priced AS (SELECT *, CASE reason WHEN 'take_profit' THEN {target[1]} WHEN 'stop_loss' THEN {stop[1]} ELSE close END AS xp FROM called WHERE reason IS NOT NULL),
firsts AS (SELECT {key}, min(j) AS xi, arg_min(jd, j) AS xd, arg_min(reason, j) AS reason, arg_min(xp, j) AS xp FROM priced GROUP BY {key}),
exits AS MATERIALIZED (SELECT ent.candidate_id, ent.symbol, ent.s AS signal_idx, e AS entry_idx, ed AS signal_date, p AS entry_price, coalesce(xi, last_idx) AS exit_idx,
                 coalesce(xd, lb.date) AS exit_date, coalesce(reason, 'max_hold') AS exit_reason, coalesce(xp, lb.close) * {1 - slip} AS exit_price{tagged}
          FROM ent LEFT JOIN firsts ON firsts.candidate_id = ent.candidate_id AND firsts.symbol = ent.symbol AND firsts.s = ent.s
          JOIN bars lb ON lb.symbol = ent.symbol AND lb.idx = ent.last_idx),
nxt AS MATERIALIZED (SELECT a.candidate_id, a.symbol, a.signal_idx, min(b.signal_idx) AS nx FROM exits a JOIN exits b
        ON a.candidate_id = b.candidate_id AND a.symbol = b.symbol AND a.exit_idx < b.signal_idx
        GROUP BY a.candidate_id, a.symbol, a.signal_idx),
chain AS (SELECT candidate_id, symbol, min(signal_idx) AS signal_idx FROM exits GROUP BY candidate_id, symbol
          UNION ALL SELECT c.candidate_id, c.symbol, n.nx FROM chain c JOIN nxt n
          ON n.candidate_id = c.candidate_id AND n.symbol = c.symbol AND n.signal_idx = c.signal_idx),
taken AS (SELECT exits.*, exit_idx - entry_idx AS holding_days,
                 round((exit_price * {1 - comm} - entry_price * {1 + comm}) / (entry_price * {1 + comm}), 6) + 0.0 AS return_pct
          FROM exits SEMI JOIN chain ON chain.candidate_id = exits.candidate_id AND chain.symbol = exits.symbol AND chain.signal_idx = exits.signal_idx)"""


TRADE_COLUMNS = """symbol, signal_idx, entry_idx, exit_idx, signal_date, exit_date, exit_reason, holding_days,
round(entry_price + 1e-9, 6) AS entry_price, round(exit_price + 1e-9, 6) AS exit_price, round(return_pct + 1e-9, 6) + 0.0 AS return_pct"""
