"""Training-data operators: thirteen document, page, vector and conversation operators and their
registered queries. Nothing outside this subpackage imports it."""
