"""Operators for preparing language-model training data, one module each.

Nothing outside this package imports it; ``registry`` lists the queries that the
driver contract picks up when the package is present.
"""
