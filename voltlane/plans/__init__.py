"""End-to-end queries built from the operators."""
