"""Whole analyses, and the projections of the driver's tables onto them."""
