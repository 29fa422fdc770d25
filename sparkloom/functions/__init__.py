"""Column functions: text, dates, URLs, statistics."""
