"""Quern: a PySpark engine for the data side of language-model post-training."""
