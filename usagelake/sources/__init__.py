"""Readers: usage logs, provider reports, and the driver tables."""
