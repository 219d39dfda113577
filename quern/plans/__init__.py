"""Registered queries: operators applied to the supplied tables, with equivalent SQL."""
