"""Concordance and corpus analytics for exam-style documents, as Spark DataFrame plans."""
