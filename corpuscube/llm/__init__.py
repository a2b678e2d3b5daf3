"""Operators for preparing language-model training data at corpus scale.

Nothing outside this package imports it.  Each module holds one operator; `spans`
and `tables` hold what they share.
"""
