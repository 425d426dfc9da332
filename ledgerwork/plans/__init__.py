"""Registered queries: the jobs wired to the driver's tables, and their SQL checks."""
