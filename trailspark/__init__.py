"""trailspark: threat-hunting analytics as PySpark DataFrame plans."""
