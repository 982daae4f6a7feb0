"""Operators on the index: matching, collecting, fusing, posting lists."""
