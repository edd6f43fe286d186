"""From predicates to the segments that may hold a match."""
