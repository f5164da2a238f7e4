"""Readers and writers of sparse count matrices."""
