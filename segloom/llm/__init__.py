"""Operators for training data of language models; nothing outside this package imports it."""
