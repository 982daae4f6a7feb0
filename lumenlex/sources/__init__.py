"""Where field values and indexes come from."""
