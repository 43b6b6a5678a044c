"""Operators for building training data: term frequencies, set sketches, packing, contamination, subject areas."""
