"""Part of the analytics engine; see README.md."""
