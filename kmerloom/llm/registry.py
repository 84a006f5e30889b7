"""The queries of this folder and their SQL, for the entry module."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("lm", "decontaminate", "warc", "secrets", "neighbours", "quality", "byte_bpe", "sharding", "token_orc", "simhash", "rules", "codes", "negatives")


def queries() -> dict:
    found: dict = {}
    for m in _MODULES:
        found |= import_module(f"kmerloom.llm.{m}").QUERIES
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracles() -> dict[str, str]:
    found: dict = {}
    for m in _MODULES:
        found |= import_module(f"kmerloom.llm.{m}").ORACLES
    return found
