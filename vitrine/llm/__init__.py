"""Operators for building language-model training text out of crawled catalogue material.

Nothing else in the library imports this subpackage. One module per operator; ``queries`` applies them to the
given tables. Records are those of the catalogue import: crawled pages (``url``, ``text``), their reviews
(``url``, ``status``: published, review or hidden), and reference texts. A key column may have any orderable type.
"""
