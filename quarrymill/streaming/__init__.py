"""The cleaning flow over files as they land."""
