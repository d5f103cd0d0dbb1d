"""Column expressions: probability vectors, proper scores, keyed draws, text keys."""
