"""functions of the signal analytics engine."""
