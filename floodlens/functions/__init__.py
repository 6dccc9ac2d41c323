"""Column functions: no data access, no shuffles."""
