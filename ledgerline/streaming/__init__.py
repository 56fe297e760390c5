"""Articles as a stream: cleaned and scored as they arrive, exact copies dropped, events carried on from batch to batch."""
