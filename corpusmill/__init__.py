"""Spark-first engine for preparing, auditing and measuring language-model corpora."""
