"""Whole runs: building a corpus, organising numbered archives, carrying out actions."""
