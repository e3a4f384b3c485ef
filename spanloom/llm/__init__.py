"""Training-data operators: one module per operator, each with its own general interface.

``queries`` holds the thin registered queries and their SQL.  Nothing outside this
subpackage imports it, apart from the guarded import in ``__spark_entry__``.
"""
