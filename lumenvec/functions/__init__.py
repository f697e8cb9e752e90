"""Vector, image-geometry and name expressions; all of them built-in Catalyst expressions."""
