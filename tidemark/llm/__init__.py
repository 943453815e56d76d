"""Operators for preparing language-model training data.

Self-contained: nothing else in the package imports it, so it can be removed as a whole.
"""
