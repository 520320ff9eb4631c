"""DataFrame operators on timelines, words, tokens and recordings."""
