"""Image operators in two layouts: rasters (one row an image, numpy) and pixels (one row a pixel, relational)."""
