"""Zonecast: trip-event analytics expressed as pure DataFrame -> DataFrame transforms."""
