"""operators of the topic engine."""
