"""Expressions over measures and attributes."""
