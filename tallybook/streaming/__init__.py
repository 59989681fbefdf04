"""The same operators over files that keep arriving."""
