"""Readers, writers, upload layouts and the star-schema adapter."""
