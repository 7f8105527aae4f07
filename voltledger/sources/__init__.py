"""Reading drops, stored tables and the meter store."""
