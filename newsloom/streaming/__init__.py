"""newsloom streaming."""
