"""Dependency-graph analytics as Spark DataFrame operators."""
