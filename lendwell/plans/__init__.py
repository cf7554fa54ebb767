"""Named queries, reports and jobs composed from the operators."""
