"""Operators for preparing language-model training data.

Each module holds one operator; ``queries`` registers them over the test tables.
Nothing outside this package imports it.
"""
