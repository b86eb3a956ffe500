"""Point-cloud operators as DataFrame transformations."""
