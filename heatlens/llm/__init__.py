"""Operators for preparing training data. Nothing else in the library imports them.

Common rules, unless an operator says otherwise: ``docs`` has ``doc_id`` and ``text``;
other columns may have any name and are left alone. A null text counts as empty. An
empty table gives an empty result of the same schema.
"""
