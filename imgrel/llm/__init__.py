"""Training-data operators.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface and, at its end, the thin ``opN_*`` query;
``queries.py`` lists the queries and the SQL that checks them.
"""
