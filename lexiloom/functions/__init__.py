"""functions of the topic engine."""
