"""Small seeded markets for the tests."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd


def walk(symbol: str, bars: int, seed: int, *, halts: bool = False, vol: float = 0.03) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0.001, vol, bars))), 4)
    open_ = np.round(np.r_[close[0], close[:-1]] * (1 + rng.normal(0, vol / 3, bars)), 4)
    top, low = np.maximum(open_, close), np.minimum(open_, close)
    volume = rng.integers(100, 1000, bars).astype(float)
    if halts:
        volume[rng.random(bars) < 0.15] = 0.0
    return pd.DataFrame(
        {
            "symbol": symbol,
            "date": [date(2023, 1, 2) + timedelta(days=i) for i in range(bars)],
            "open": open_,
            "high": np.round(top * (1 + rng.random(bars) * vol / 2), 4),
            "low": np.round(low * (1 - rng.random(bars) * vol / 2), 4),
            "close": close,
            "volume": volume,
            "prev_close": np.r_[np.nan, close[:-1]],
        }
    )


def market(symbols: int = 4, bars: int = 150, **options) -> pd.DataFrame:
    return pd.concat([walk(f"S{i}", bars + 7 * i, i + 1, **options) for i in range(symbols)], ignore_index=True)
