"""Training-data operators. Nothing outside this subpackage imports it, apart from the guarded entry module."""
