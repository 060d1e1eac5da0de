"""Operators for training-data corpora; each module documents its own rules."""
