"""Schemas, options and the batch plan that joins the operators."""
