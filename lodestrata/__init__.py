"""Lodestrata: code-health and corpus analytics expressed as Spark DataFrame plans."""
