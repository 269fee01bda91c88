"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` derives the registered ``opN_*`` queries from them.
"""
