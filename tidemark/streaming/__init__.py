"""Structured Streaming extensions: incremental manifests and running statistics."""
