"""Physical operators over DataFrames: layout, dictionaries, encodings, codecs."""
