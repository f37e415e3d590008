"""Sessions of table versions, payloads for charts, and the driver contract's queries."""
