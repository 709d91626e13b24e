"""Landed files to bronze to silver with Structured Streaming; gold is a batch over the silver sink."""
