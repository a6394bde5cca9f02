"""Query trees, their builder, the catalog and the compiler."""
