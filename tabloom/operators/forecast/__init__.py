"""Forecasting many series in parallel: one row group per series key."""
