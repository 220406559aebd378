"""Lexical scanners: declarations, references, statistics and tokens of source files.

There is no parser here. A scanner masks comments and strings and then reads
tokens and line shapes; Python, JSON and HTML have parsers in the standard
library and use them. Numbers that need a full grammar (syntax errors above
all) are approximations and say so.
"""
