"""Incremental index build."""
