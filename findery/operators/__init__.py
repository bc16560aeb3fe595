"""DataFrame operators: one function per step of a search, a report or an extraction job."""
