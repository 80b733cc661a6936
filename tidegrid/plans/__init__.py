"""Backtest plans: configurations, origins, training windows and horizons."""
