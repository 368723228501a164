"""Operators for preparing training corpora: text, web pages and source mixing.

Nothing outside this folder imports it.
"""
