"""Structured Streaming: stateless scoring of arriving request rows."""
