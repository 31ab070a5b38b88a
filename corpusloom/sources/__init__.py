"""Inputs: file trees, element tables, ignore rules."""
