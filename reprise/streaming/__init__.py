"""Extension: episodes of a ticket stream. Batch jobs need none of it."""
