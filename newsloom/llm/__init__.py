"""Training-data operators. Nothing else in newsloom imports this subpackage."""
