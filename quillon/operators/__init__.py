"""Relational operators over documents, claims, leads, runs and transcripts."""
