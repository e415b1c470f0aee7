"""Operators on texts measured in tokens of a public tokenizer."""
