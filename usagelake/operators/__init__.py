"""Analytical operators over usage events."""
