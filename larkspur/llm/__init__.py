"""Operators for preparing training corpora.

Nothing else in the library imports this package.  ``queries`` lists the
registered queries, ``sql`` their DuckDB counterparts where SQL can express them.
"""
