"""Corvane: retrieval evaluation and corpus analytics as PySpark DataFrame jobs."""
