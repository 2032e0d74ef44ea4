"""Jobs of the delivery-text library."""
