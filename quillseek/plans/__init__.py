"""Search plans and the queries that exercise them."""
