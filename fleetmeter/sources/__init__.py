"""Reading the facts and putting them together."""
