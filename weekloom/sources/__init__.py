"""Readers for landed files and writers for the state tables."""
