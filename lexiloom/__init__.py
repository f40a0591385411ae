"""Topic analytics over large text collections on Spark."""
