"""Sources of the content-security engine."""
