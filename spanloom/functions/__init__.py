"""Column functions: no data, no session, only expressions."""
