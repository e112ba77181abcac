"""plans of the signal analytics engine."""
