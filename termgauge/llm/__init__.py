"""Operators for training data, each built by its own method; nothing else here imports them."""
