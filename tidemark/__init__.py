"""Strategy analytics on Spark: indicators, signals, backtests and validation as DataFrame plans."""
