"""Operators for preparing large text and media corpora; nothing else in the library imports this."""
