"""Operators for preparing large text corpora for language-model training.

Each module holds one operator with a general DataFrame interface; ``queries``
registers the thin ``opN_<name>`` queries on top of them.
"""
