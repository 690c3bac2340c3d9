"""Operators that prepare text corpora for training: cleaning, deduplication, scoring, mixing, encoding."""
