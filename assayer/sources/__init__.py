"""sources of the conduct-analytics engine."""
