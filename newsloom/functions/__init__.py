"""newsloom functions."""
