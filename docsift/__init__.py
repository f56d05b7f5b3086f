"""docsift: document-to-record extraction on Spark."""
