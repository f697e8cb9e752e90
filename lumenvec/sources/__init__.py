"""Readers of dense arrays, manifests and annotations, and writers of their counterparts."""
