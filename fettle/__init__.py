"""Inspection analytics on Spark: history, corpus, evaluation and stream operators."""
