"""Column functions: coercion, normalisation, tokens and stop words."""
