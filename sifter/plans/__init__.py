"""sifter.plans."""
