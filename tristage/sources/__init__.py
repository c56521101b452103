"""Readers, writers and artifact fingerprints."""
