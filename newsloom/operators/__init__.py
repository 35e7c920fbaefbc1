"""newsloom operators."""
