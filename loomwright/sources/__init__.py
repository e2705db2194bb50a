"""Tables from and to files."""
