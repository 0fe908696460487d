"""Streaming frames: the column functions apply as they are; this adds stateless encoding."""
