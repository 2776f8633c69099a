"""Operators for preparing large text corpora: one module per operator, their queries in ``queries``.

Nothing else in the package imports this subpackage.
"""
