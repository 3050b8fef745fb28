"""Readers and decoders of raw files."""
