"""Freight demand forecasting and line-haul analytics as PySpark DataFrame operators."""
