"""Outputs: consolidated text, JSON, per-document text, CSV."""
