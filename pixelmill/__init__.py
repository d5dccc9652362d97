"""Image-collection analytics on PySpark: images and pixels as tables, tools as DataFrame operators."""

__version__ = "0.1.0"
