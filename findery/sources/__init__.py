"""Reading indexes, pages and request URLs; writing the search and click logs."""
