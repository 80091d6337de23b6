"""streaming of loomtrace."""
