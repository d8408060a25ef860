"""Registered queries: every module here adds its entries to the catalog on import."""
