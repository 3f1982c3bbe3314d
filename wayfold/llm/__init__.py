"""Training-data operators over text corpora. Nothing else in the package imports this one."""
