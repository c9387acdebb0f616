"""Text operators for training data that accompanies raster data sets.

The project's own records carry images, masks, tiles and annotations but hardly any text, so the operators take any
table keyed like its records (``source_id``, ``text``, and where needed ``batch``) and say in their docstrings where
they use image records, tile grids or annotation fields.  Each module names its method.  No other part of the library
imports this package.
"""
