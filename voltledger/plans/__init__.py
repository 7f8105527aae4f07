"""The import and mapping jobs."""
