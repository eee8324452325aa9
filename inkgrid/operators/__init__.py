"""DataFrame operators of the document-text engine."""
