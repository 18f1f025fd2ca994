"""Graph operators as DataFrame transformations."""
