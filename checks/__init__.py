"""Registered queries over the sample tables, and the SQL they are compared with."""
