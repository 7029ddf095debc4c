"""Stateful stages over streams, and their batch twins."""
