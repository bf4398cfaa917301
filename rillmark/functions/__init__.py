"""Functions on binary and text columns."""
