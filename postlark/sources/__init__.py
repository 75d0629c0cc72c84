"""Readers and writers: posts, CSV landing directories and the language lookup."""
