"""Records from streams of text."""
