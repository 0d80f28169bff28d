"""Training-data operators. Nothing else in plumbline imports this subpackage."""
