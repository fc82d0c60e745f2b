"""Relational operators over files, chunks, vectors and search hits."""
