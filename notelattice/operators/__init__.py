"""Relational operators over the engine's tables."""
