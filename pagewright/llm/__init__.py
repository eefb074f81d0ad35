"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it. Each module holds one operator and
``queries`` registers the ``opN_<name>`` queries built on them.
"""
