"""Use on streams.

Nothing the reference computes is defined on streams, so there is no stateful
operator here. The operators without a shuffle (``nested.node_rows``,
``nested.flat_tables``, ``units.condition_values``, ``units.range_values``,
``star.parse``, ``coil.shifts_at_ph7``) take a streaming DataFrame as it is.
"""
