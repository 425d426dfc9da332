"""Billing and ledger analytics for a metered utility, as PySpark DataFrame jobs."""
