"""Operators over tables of photos, detections, annotations and manifests."""
