"""Captured web traffic to typed record tables, as Spark DataFrame operators."""
