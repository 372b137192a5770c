"""Structured Streaming form of the alert job."""
