"""Column functions: Catalyst expressions without Python workers."""
