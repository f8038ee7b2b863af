"""Where pages come from, and where memos and caches go."""
