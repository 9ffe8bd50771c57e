"""Operators for training data from text and vectors. Nothing outside this subpackage imports it."""
