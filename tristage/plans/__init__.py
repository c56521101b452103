"""The operators applied to the test tables: every query with its reference SQL where SQL can say it."""
