"""Retail demand and replenishment analytics as DataFrame-to-DataFrame operators on Spark."""
