"""Structured Streaming: snapshot sinks, running reports and sessions."""
