"""See the README for what is here."""
