"""sources of the signal analytics engine."""
