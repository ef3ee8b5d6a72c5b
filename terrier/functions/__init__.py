"""Part of terrier."""
