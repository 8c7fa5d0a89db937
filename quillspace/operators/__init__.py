"""Vector, lexical and ranking operators over DataFrames."""
