"""Column functions: text, URLs, media labels, numbers and dates."""
