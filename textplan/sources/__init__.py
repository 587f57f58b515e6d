"""sources of the template engine."""
