"""Readers of captured responses: provider payloads, feeds, sitemaps, robots files, and texts."""
