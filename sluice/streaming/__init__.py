"""Change feeds applied batch by batch."""
