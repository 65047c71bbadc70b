"""Readers and writers: images, JSON artefacts, cell tables, metadata."""
