"""Operators on text corpora for language-model training data; nothing else in the library imports this."""
