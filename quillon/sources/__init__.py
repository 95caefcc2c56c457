"""Readers of landed files: feeds, captions, sitting records, artifacts."""
