"""Structured Streaming counterparts of the state, crawl and job operators."""
