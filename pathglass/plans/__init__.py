"""Requests to plans, pages and text; and the registered queries with their SQL."""
