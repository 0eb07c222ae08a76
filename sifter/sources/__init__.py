"""sifter.sources."""
