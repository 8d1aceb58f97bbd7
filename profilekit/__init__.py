"""Profiling, anomaly detection and feature preparation for wide tables, written as Spark jobs."""
