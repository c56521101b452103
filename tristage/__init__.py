"""Outcome-benchmark construction and auditing as Spark DataFrame operators."""
