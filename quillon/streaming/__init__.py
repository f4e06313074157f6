"""Streams of events: the same counts and alerts as in batch, with watermarks that bound the state."""
