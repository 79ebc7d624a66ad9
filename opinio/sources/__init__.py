"""Readers, writers, feature store and model persistence."""
