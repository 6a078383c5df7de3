"""Part of tesserae."""
