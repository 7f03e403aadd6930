"""Reports, and file actions written down as reviewable tables."""
