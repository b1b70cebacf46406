"""Coordinate reference systems as metadata: nothing here moves a point."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Geographic codes that need no name lookup.
_GEOGRAPHIC = {4326: "WGS 84", 4269: "NAD83", 4258: "ETRS89", 4979: "WGS 84 (3D)"}


def _name(epsg: int) -> str | None:
    if epsg in _GEOGRAPHIC:
        return _GEOGRAPHIC[epsg]
    if epsg == 3857:
        return "WGS 84 / Pseudo-Mercator"
    for first, side in ((32600, "N"), (32700, "S")):
        if 1 <= epsg - first <= 60:
            return f"WGS 84 / UTM zone {epsg - first}{side}"
    return None


@dataclass(frozen=True)
class CRS:
    """A system by its EPSG code, its WKT, or both; neither means unknown."""

    wkt: str = ""
    epsg: int = 0

    @classmethod
    def from_epsg(cls, code: int) -> CRS:
        name = _name(code)
        if name is None:
            return cls("", code)
        kind = "GEOGCS" if code in _GEOGRAPHIC else "PROJCS"
        return cls(f'{kind}["{name}",AUTHORITY["EPSG","{code}"]]', code)

    @classmethod
    def from_wkt(cls, wkt: str) -> CRS:
        """The last authority names the whole system, earlier ones its parts."""
        codes = re.findall(r'(?:AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?|ID\s*\[\s*"EPSG"\s*,\s*)(\d+)', wkt, re.I)
        return cls(wkt, int(codes[-1]) if codes else 0)

    @property
    def known(self) -> bool:
        return bool(self.wkt or self.epsg)

    @property
    def is_geographic(self) -> bool:
        return self.wkt.lstrip().upper().startswith(("GEOGCS", "GEOGCRS", "GEODCRS")) or (not self.wkt and self.epsg in _GEOGRAPHIC)

    @property
    def is_projected(self) -> bool:
        if self.wkt:
            return self.wkt.lstrip().upper().startswith(("PROJCS", "PROJCRS"))
        return bool(self.epsg) and not self.is_geographic and (_name(self.epsg) is not None or self.epsg > 5000 or 2000 <= self.epsg < 4000)

    def equivalent_to(self, other: CRS) -> bool:
        if self.epsg and other.epsg:
            return self.epsg == other.epsg
        squeeze = lambda w: re.sub(r"\s+", "", w).upper()
        return squeeze(self.wkt) == squeeze(other.wkt) and self.known == other.known
