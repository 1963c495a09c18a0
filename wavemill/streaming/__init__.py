"""Learning from streams."""
