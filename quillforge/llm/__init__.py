"""Operators for text that trains or comes from language models. Nothing outside this package imports it."""
