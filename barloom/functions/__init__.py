"""Column builders and small exact scalar mathematics."""
