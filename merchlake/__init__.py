"""Distributed commerce-event processing on Spark: landing, conforming and serving tables."""
