"""Operators for text corpora: token encoding, source mixing, sentence units, surviving records."""
