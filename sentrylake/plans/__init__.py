"""Plans of the content-security engine."""
