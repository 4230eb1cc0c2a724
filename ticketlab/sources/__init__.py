"""ticketlab.sources."""
