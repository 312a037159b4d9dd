"""Declarative packs: specification, planning into DataFrames, minting, verification, reproduction."""
