"""Column expressions over text, cells and numbers."""
