"""Operators for preparing training data at scale.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
