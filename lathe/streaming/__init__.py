"""Results as a stream of text lines."""
