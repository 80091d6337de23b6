"""sources of loomtrace."""
