"""Operators on text for language models; nothing else in the library imports these."""
