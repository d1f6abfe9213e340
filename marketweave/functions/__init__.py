"""Null-safe column helpers."""
