"""Operators over DataFrames of files, names, links and directory entries."""
