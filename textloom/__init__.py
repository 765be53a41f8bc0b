"""Corpus rule analytics and training-data operators on Spark."""
