"""sources of the topic engine."""
