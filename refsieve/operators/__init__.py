"""DataFrame operators: duplicate flags, packed fields, sorting, vector similarity."""
