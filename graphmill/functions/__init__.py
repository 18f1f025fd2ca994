"""Text functions."""
