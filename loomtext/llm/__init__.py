"""Operators of a large-scale training-data pipeline; nothing else in loomtext imports them."""
