"""plans of the conduct-analytics engine."""
