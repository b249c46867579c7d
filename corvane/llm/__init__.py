"""Operators for preparing training corpora.

Nothing outside this folder imports it. ``queries`` lists the registered
queries and ``oracles`` the SQL they are compared with, where SQL can say it.
"""
