"""Views that are kept up to date by Structured Streaming."""
