"""Readers and writers of alignments, structures, metrics and votes."""
