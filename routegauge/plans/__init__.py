"""Registered queries: raw tables in, one operator's result out."""
