"""Where contracts and data come from."""
