"""Column builders and Arrow functions shared by the operators."""
