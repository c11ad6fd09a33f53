"""Assurance analytics on Spark: traces, documents, claims and reconciliations as DataFrame operators."""
