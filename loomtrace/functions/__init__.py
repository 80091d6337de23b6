"""functions of loomtrace."""
