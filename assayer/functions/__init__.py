"""functions of the conduct-analytics engine."""
