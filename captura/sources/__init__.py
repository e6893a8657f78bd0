"""Readers and writers for manifests, listings, annotations and results."""
