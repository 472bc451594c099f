"""Manifests of written tables."""
