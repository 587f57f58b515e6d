"""operators of the template engine."""
