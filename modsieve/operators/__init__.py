"""operators of the moderation engine."""
