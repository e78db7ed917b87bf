"""Registered queries, their SQL, and the comparison of the two."""
