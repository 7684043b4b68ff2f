"""Readers, payload normalisers and table sinks."""
