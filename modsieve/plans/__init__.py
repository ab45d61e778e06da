"""plans of the moderation engine."""
