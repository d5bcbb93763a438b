"""Operators for preparing training data for language models; nothing outside imports them."""
