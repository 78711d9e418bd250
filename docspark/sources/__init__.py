"""Collections over typed frames and schemaless documents, and where they are stored."""
