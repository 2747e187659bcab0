"""Corpus curation and annotation analytics as Spark DataFrame operators."""
