"""Writing the meter store."""
