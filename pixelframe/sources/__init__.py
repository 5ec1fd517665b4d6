"""Reading and writing image files, and the codecs between bytes and rasters."""
