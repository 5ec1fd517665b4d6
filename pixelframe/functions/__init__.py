"""Column functions: numeric rules, headers of image files, error structs."""
