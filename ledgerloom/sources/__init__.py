"""Readers and writers: billing exports, manifests, API pages, the model's tables."""
