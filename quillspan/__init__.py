"""Text-corpus analytics on Spark."""
