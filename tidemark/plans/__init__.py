"""Registered queries: operators composed over the driver's tables, with equivalent SQL."""
