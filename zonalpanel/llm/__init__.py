"""Operators for preparing training data: encoding, archives, filters, duplicates, packing."""
