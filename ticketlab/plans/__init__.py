"""ticketlab.plans."""
