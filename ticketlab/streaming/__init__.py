"""ticketlab.streaming."""
