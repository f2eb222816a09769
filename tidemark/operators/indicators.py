"""Exponentially weighted indicators by series, in linear time (``applyInPandas`` by symbol)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def exponential(bars: DataFrame) -> DataFrame:
    """EMA-10, MACD with signal and histogram, RSI-14, from closes ordered by day (adjusted weights).

    One symbol's daily bars are one group: bounded by the number of days.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_us")
        close = pdf["close"]
        ewm = lambda s, n: s.ewm(span=n, adjust=True).mean()
        macd = ewm(close, 12) - ewm(close, 26)
        signal = ewm(macd, 9)
        move = close.diff()
        up, down = (x.ewm(alpha=1 / 14, adjust=True).mean() for x in (move.clip(lower=0).iloc[1:], (-move).clip(lower=0).iloc[1:]))
        rsi = (100 * up / (up + down)).reindex(pdf.index)
        return pd.DataFrame({"symbol": pdf["symbol"], "day_us": pdf["day_us"], "ema_10": ewm(close, 10).round(6), "macd": macd.round(6), "macd_signal": signal.round(6), "macd_hist": (macd - signal).round(6), "rsi_14": rsi.round(4)})

    return bars.select("symbol", "day_us", "close").groupBy("symbol").applyInPandas(run, "symbol bigint, day_us bigint, ema_10 double, macd double, macd_signal double, macd_hist double, rsi_14 double")
