"""streaming of the topic engine."""
