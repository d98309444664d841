"""Column functions; each has a plain definition and is built from Catalyst expressions."""
