"""Column functions: text, URLs, HTML, fuzzy similarity, vectors."""
