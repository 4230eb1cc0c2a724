"""ticketlab.operators."""
