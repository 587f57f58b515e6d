"""functions of the template engine."""
