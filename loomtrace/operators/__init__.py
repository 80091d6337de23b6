"""operators of loomtrace."""
