"""Readers, writers and small artefact tables."""
