"""Readers: listings, texts, word-processor files, web pages, archives, settings."""
