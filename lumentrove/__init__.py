"""Camera-geometry, asset-verification and corpus-preparation operators on PySpark."""
