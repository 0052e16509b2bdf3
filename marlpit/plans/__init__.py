"""Plan inspection and results."""
