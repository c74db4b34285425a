"""Column functions over ticket text, and the fixed values they rest on."""
