"""Keyed state over streams, each with a twin over finite tables."""
