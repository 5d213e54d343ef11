"""Operators on document text: packing, mixing, reading level."""
