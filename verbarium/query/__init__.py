"""The positional text query language: text or JSON -> tree -> one column expression per document."""
