"""Operators for building training data at scale.

Nothing else in the library imports this subpackage. Every module holds one
operator; ``queries`` registers one query for each of them.
"""
