"""Readers and writers of texts, audio, alignments and exports."""
