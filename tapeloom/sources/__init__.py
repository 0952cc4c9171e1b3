"""Readers and adapter views."""
