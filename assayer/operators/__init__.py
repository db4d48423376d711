"""operators of the conduct-analytics engine."""
