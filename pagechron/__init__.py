"""Page dating on Spark: date candidates from pages, resolved to one answer each."""
