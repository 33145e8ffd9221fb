"""Spark-first analytics for daily bars, plus (optionally) training-data operators in ``tidemark.llm``."""
