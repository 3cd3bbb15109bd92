"""Operators for training data: text splitting, look-alikes, garbled encodings, packing, leaks, languages."""
