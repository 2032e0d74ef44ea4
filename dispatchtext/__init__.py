"""Delivery-text jobs on Spark."""
