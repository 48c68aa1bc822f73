"""Operational metrics for order data, expressed as Spark DataFrame operators."""
