"""Column builders. Nothing here needs Python workers."""
