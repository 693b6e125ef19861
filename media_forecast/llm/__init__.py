"""Training-data operators: ten text, vector and token operators and their queries."""
