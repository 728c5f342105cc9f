"""Reusable physical recipes for work that must not end up in a single task."""
