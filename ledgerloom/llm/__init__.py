"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module has one operator with
a general interface; ``queries`` applies them to the driver tables.
"""
