"""Readers of rule files."""
