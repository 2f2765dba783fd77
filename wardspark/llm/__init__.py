"""Operators for preparing training data: joins, searches, classifiers, tokenisation, mixing, archives.

Nothing else in the library imports this package.
"""
