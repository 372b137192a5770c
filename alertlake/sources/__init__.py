"""Readers of landed logs and stored batches, and the sinks."""
