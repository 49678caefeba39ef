"""Column-to-column functions; no Python UDFs in this package."""
