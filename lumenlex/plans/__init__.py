"""Search expressions."""
