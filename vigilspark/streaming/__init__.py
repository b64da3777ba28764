"""The feed board as a stream."""
