"""Streaming of the delivery-text library."""
