"""Spark-native analytics over evidence-weighted knowledge graphs and the text records behind them."""
