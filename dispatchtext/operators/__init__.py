"""Operators of the delivery-text library."""
