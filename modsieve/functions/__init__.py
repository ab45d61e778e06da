"""functions of the moderation engine."""
