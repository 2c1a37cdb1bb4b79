"""Operators that prepare text for training: cleaning, filtering, matching, packing."""
