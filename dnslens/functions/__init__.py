"""Column functions (``Column -> Column``)."""
