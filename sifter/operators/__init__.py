"""sifter.operators."""
