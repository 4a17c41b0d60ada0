"""Readers, writers, schemas and jobs."""
