"""Search, change data, history, replication and session operators."""
