"""Operators for preparing training data: cleaning, near-copies, mixing, packing, chat."""
