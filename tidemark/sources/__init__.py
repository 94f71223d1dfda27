"""Reading and writing the event and label tables."""
