"""The default list of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The symbols covered by default; their order is their rank.
SYMBOLS = [
    "QQQ", "SPY", "IWM", "DIA", "XLF", "XLK", "XLE", "XLV", "XLY", "XLP",
    "XLI", "XLU", "XLB", "TLT", "HYG", "EEM", "VXX", "SQQQ", "TQQQ", "UVXY",
    "AAPL", "MSFT", "GOOGL", "GOOG", "AMZN", "NVDA", "TSLA", "META",
    "AMD", "INTC", "MU", "QCOM", "AVGO", "TXN", "AMAT", "LRCX", "TSM", "SMH",
    "JPM", "BAC", "WFC", "C", "GS", "MS", "V", "MA", "AXP", "BLK",
    "HD", "LOW", "MCD", "SBUX", "NKE", "WMT", "TGT", "COST", "PG", "KO", "PEP",
    "XOM", "CVX", "COP", "SLB", "EOG", "OXY", "NEE", "DUK", "SO",
    "JNJ", "PFE", "MRK", "ABBV", "LLY", "UNH", "CVS", "AMGN", "GILD",
    "BA", "CAT", "DE", "GE", "HON", "LMT", "RTX", "UPS", "FDX",
    "T", "VZ", "DIS", "CMCSA", "NFLX",
    "F", "GM", "RIVN", "LCID", "NIO",
    "COIN", "MARA", "RIOT", "MSTR",
    "PLTR", "SOFI", "DKNG", "UBER", "LYFT", "HOOD", "ROKU", "SHOP", "SQ",
    "AFRM", "UPST", "AI", "GME", "AMC",
]


def universe(spark: SparkSession, symbols: list[str] = SYMBOLS) -> DataFrame:
    """``symbol, rank``."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(symbols)], "symbol string, rank int")
