"""Sondage: inspection analytics as DataFrame plans."""
