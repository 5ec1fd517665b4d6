"""What is decided before any row is read: sizes, taps, and the stages of a recipe."""
