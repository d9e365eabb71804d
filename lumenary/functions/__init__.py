"""Part of lumenary."""
