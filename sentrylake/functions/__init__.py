"""Functions of the content-security engine."""
