"""plans of the topic engine."""
