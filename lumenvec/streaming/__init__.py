"""An extension: new vectors assigned to frozen centroids as they arrive."""
