"""Column functions: text analysis and scoring."""
