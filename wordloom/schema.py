"""Schemas of the tables that operators exchange."""

WORDS = "recording_id long, index long, word string, start_frame long, end_frame long, score double, original string"
CHARS = "recording_id long, word_index long, pos int, char string, start double, end double, score double"
TOKENS = "recording_id long, segment_index int, pos int, token_id long, frame long, score double, wid long, tk string, word string, is_exit boolean"
SEGMENTS = "recording_id long, segment_index int, offset long, length long, frame_offset long, rejected boolean"
HOLES = "recording_id long, start_idx long, end_idx long"
INTERVALS = "recording_id long, start double, end double"
EMISSIONS = "recording_id long, segment_index int, frame int, logp array<double>"
TRANSCRIPTS = "recording_id long, text string"
REFERENCE = "recording_id long, idx int, original string, normalized string"
ARCS = "doc_id long, src int, dst int, label int, aux int, score double"
