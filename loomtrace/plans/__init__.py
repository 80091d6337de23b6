"""plans of loomtrace."""
