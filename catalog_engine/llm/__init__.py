"""Operators for preparing training text, each a function on DataFrames; nothing else in the library imports them.

Unless an operator says otherwise: a null text counts as empty, a null id stays null in the result, repeated rows are
judged one by one, other columns of the input are neither read nor required to have particular names, and an empty table
gives an empty result with the same columns.
"""
