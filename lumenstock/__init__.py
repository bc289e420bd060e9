"""Catalogue intelligence on Spark: governed product data as set-based DataFrame jobs."""
