"""Readers that turn landed files and pages into candidates, and the registry that picks one for a source."""
