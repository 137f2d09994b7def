"""Named queries and end-to-end runs composed from the operators."""
