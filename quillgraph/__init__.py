"""Corpus analytics as Spark DataFrame operators."""
