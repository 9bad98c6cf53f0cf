"""Masks and windows over streams."""
