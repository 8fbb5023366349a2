"""Segmented delivery-time estimation on Spark."""
