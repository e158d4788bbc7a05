"""Session and table access."""
