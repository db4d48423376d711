"""streaming of the conduct-analytics engine."""
