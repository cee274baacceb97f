"""Where streams come from."""
