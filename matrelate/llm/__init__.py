"""Operators for preparing language-model training corpora.

Self-contained: nothing else in the library imports this subpackage.  Each
module holds one operator with a general interface; ``queries`` registers the
thin ``opN_*`` queries on top of them.
"""
