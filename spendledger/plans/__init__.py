"""Views, reports and the load plan built from the operators."""
