"""Operators that prepare training data: one module for each operator.

Nothing else in :mod:`lodestone` imports this subpackage.
"""
