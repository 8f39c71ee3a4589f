"""Plans made of the operators: building, documents, reports, registered queries."""
