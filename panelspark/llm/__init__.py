"""Training-data operators and the corpus pipeline's building blocks."""
