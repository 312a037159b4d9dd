"""Small lexicons and tables of our own, for queries and the bundled pack."""

from __future__ import annotations

from functools import cache
from math import exp
from statistics import NormalDist

GIVEN = ["Ada", "Işıl", "Çınar", "Deniz", "Gülce", "İpek", "Kâmil", "Özgür", "Şule", "Umut", "Yağız", "Zehra"]
SURNAMES = ["Akağaç", "Bozkır", "Çiftçi", "Demirel", "Gökçe", "Işık", "Karaşın", "Öztürk", "Şahinbaş", "Ulu", "Yıldız"]
PLACES = ["Kuzeyova", "Göltepe", "Şirinköy", "Akçapınar", "Yeşilırmak Kıyısı", "Doğanay", "Üçpınar"]


@cache
def lognormal_knots(median: int, sigma: float, low: int, high: int, knots: int = 1024) -> tuple[int, ...]:
    """The inverse distribution function at the knots' midpoints, rounded and clamped: an ascending table of integers."""
    normal = NormalDist()
    values = [round(median * exp(sigma * normal.inv_cdf((i + 0.5) / knots))) for i in range(knots)]
    return tuple(min(high, max(low, v)) for v in values)


def amounts_table() -> tuple[int, ...]:
    return lognormal_knots(85_000, 1.1, 100, 50_000_000, 128)
