"""One function for each node of a query tree, and table statistics."""
