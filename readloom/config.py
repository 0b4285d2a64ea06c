"""Options of a run, and the command line that sets them."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


def parse_denoise(text: str | None, as_float: bool = False) -> tuple[int | None, int | None]:
    """(min_copies, min_kmer) from ``x`` or ``x.y``: y has three digits, shorter ones are filled up with zeros.

    The digits are read as text, so 1.005 means 5; as_float reads a binary number and cuts off, so that it means 4.
    An empty text asks for support by two alone.
    """
    if text is None:
        return None, None
    if not text:
        return None, 2
    copies, _, support = text.partition(".")
    if not (copies or "0").isdecimal() or (support and not support.isdecimal()) or len(support) > 3:
        raise ValueError(f"not a denoising level: {text}")
    if as_float:
        value = float(text)
        return int(value), int((value - int(value)) * 1000) or None
    return int(copies or 0), int(support.ljust(3, "0")) or None if support else None


@dataclass
class Config:
    """Options of a run. With ``alignment`` (lines of SAM) and ``counts`` (the file of samples and count lines) no reads are needed."""

    reads: str
    out: str
    database: str
    name: str = "references"
    reads2: str | None = None
    trim: int | None = None
    trim2: int | None = None
    similarity: float = 0.97
    indels: bool = True
    max_insert: int = 1400
    denoise: str | None = "1"
    k: int = 32
    support: str = "aligned"
    ambiguous: str = "reject"
    rc: bool = False
    both_strands: bool = False
    compact: bool = True
    flush_end: str = "reject"
    tolerance: int = 0
    legacy: bool = False
    logs: bool = False
    check: bool = False
    alignment: str | None = None
    counts: str | None = None
    pe_count: str = "pairs"
    pe_key: str = "split"
    denoise_float: bool = False
    least_read: int = 1

    def validate(self) -> Config:
        if not self.reads and not self.alignment:
            raise ValueError("no input")
        if bool(self.alignment) != bool(self.counts):
            raise ValueError("an alignment needs the counts of its sequences")
        if self.trim2 is not None and self.trim is None:
            raise ValueError("a trim of the second mates needs one of the first")
        if self.trim2 is None:
            self.trim2 = self.trim
        if not 0 <= self.similarity <= 1:
            raise ValueError("similarity is a share of 1")
        for name, most in (("support", ("aligned", "endpiece", "deep")), ("ambiguous", ("reject", "convert")), ("flush_end", ("reject", "accept")), ("pe_count", ("pairs", "lines")), ("pe_key", ("split", "joined"))):
            if getattr(self, name) not in most:
                raise ValueError(f"{name} is one of {', '.join(most)}")
        parse_denoise(self.denoise, self.denoise_float)
        return self


def from_arguments(arguments: list[str]) -> Config:
    """``--reads a.fna --out folder --database folder --name refs``; two files of mates as ``a.fna,b.fna``."""
    parser = argparse.ArgumentParser(prog="readloom")
    for f in fields(Config):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            kind = int if "int" in f.type else float if f.type == "float" else str
            parser.add_argument(flag, type=kind, **({"required": True} if f.name in ("out", "database") else {"default": ""} if f.name == "reads" else {"default": f.default}))
    found = vars(parser.parse_args(arguments))
    if "," in found["reads"] and not found["reads2"]:
        found["reads"], found["reads2"] = found["reads"].split(",", 1)
    return Config(**found).validate()
