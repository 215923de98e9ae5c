"""Training-data operators: thirteen operators over text and vector tables, one module each."""
