"""Operators composed into the user-level reports."""
