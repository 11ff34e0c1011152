"""Media assets as tables: archives, audio, textures and their codecs on Spark."""
