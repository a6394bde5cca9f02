"""Readers and writers of pipe-delimited files and of block files."""
