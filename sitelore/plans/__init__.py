"""Options, job planning, and the registered queries with their SQL."""
