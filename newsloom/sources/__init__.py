"""newsloom sources."""
