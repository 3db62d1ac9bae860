"""The assessment relations, from the corpus to the dashboard figures."""
