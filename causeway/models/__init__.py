"""Graph networks and their training."""
