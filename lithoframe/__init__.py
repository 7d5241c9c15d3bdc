"""lithoframe: spatial, raster, graph and spectral analytics as PySpark DataFrame operators."""
