"""Tables and files: reading, flattening, writing."""
