"""Column functions: indicators in text, normalisation, scores."""
