"""Column functions: text, URLs, scores. None of them runs Python for a row but those named so."""
