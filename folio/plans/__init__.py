"""The operators applied to tables, as queries with their SQL."""
