"""Card-catalogue analytics on Spark: market pages, set catalogues and image matching."""
