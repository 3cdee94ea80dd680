"""Retail demand and inventory analytics as Spark DataFrame operators."""
