"""The same counts over files that keep arriving."""
