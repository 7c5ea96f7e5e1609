"""Operators of a training-data pipeline: counting, mixing, packing, filtering and matching texts.

Nothing outside this folder imports it. Every operator names its columns as arguments, reads only
those, and keeps other columns of the input out of its way."""
