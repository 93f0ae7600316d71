"""Operators for preparing language-model training data.

Ten operators (one module each) and the thin ``opN_`` queries over the driver
tables (``queries.py``). Nothing else in the library imports this package.
"""
