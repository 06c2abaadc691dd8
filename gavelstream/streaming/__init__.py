"""Operators whose streaming form differs from the batch form, and the stream runner."""
