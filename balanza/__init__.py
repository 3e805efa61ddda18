"""Supervisory-finance analytics as Spark DataFrame operators."""
