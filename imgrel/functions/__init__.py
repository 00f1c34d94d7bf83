"""Column functions: parsing, geometry, negotiation, signing, URL rules."""
