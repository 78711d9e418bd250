"""Live queries, subscriptions and feeds on Structured Streaming."""
