"""One module per family of table operators."""
