"""ticketlab.functions."""
