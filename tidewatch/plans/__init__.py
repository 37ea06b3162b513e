"""Jobs composed of operators: the detection cycle, the backtest and the serving tables."""
