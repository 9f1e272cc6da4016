"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` derives the registered
queries from them.
"""
