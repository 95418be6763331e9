"""Query operators: terms, the operator syntax, object queries, logical queries and tokens."""
