"""Sources of the delivery-text library."""
