"""Named queries, their oracles, and what holds intermediate tables."""
