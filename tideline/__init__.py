"""Spark-native analysis of timestamped observations: ingest, aggregation, quality rules, causal graphs and state-space models."""
