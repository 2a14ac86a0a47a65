"""quire: document search, extraction and engagement analytics on Spark."""
