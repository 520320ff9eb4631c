"""Column builders: text, numbers, scripts, tokenizers and label scores."""
