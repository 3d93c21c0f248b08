"""Relational operators on alignments, features, graphs and partitions."""
