"""Column functions: text cleaning, tokens, dates."""
