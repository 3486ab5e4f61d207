"""Channel specs: YAML or JSON text to validated dataclasses."""

from recordloom.spec.loader import Channel, Member, SpecError, load_channels, parse_channels

__all__ = ["Channel", "Member", "SpecError", "load_channels", "parse_channels"]
