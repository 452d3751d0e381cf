"""Coding of atoms: transform, quantiser, range coder, in Arrow batches."""
