"""Plumbline: data quality, anomaly review and distributions as Spark jobs."""
