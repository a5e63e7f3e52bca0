"""Part of lakeglass."""
