"""streaming of the signal analytics engine."""
