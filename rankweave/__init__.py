"""Hybrid retrieval analytics as DataFrame plans."""
