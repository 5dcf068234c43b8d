"""Collections that grow."""
