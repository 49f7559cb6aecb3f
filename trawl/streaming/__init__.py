"""Resumable appends."""
