"""plans of the template engine."""
