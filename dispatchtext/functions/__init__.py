"""Functions of the delivery-text library."""
