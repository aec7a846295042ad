"""Readers of files and archives, and writers of the library's tables."""
