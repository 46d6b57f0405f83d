"""Spark analytics for host metrics: ingest, features, anomalies, forecasts, KPIs."""
