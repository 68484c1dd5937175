"""Run settings: file values, then environment, then explicit ones."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Settings:
    """Names are the dotted keys with '_' for '.'."""

    genome_dir: str = "."
    genome_reference: str = "."
    genome_taxonomy: str = "."
    genome_reports: str = "."
    reads_dir: str = "."
    reads_paired1: str = ""
    reads_paired2: str = ""
    out_dir: str = "."
    out_cov: str = "cov"
    out_sam: str = "sam"
    out_ortho: str = "ortho"
    out_plot: str = "plot"
    out_fit: str = "fit"
    out_prefix: str = ""
    cov_maxl: int = 600
    cov_functions: tuple[str, ...] = field(default=())
    cov_positions: tuple[int, ...] = field(default=())
    bowtie2_options: tuple[str, ...] = field(default=())
    species_file: str = ""
    fit_exp_start: int = 0
    fit_exp_end: int = 0
    fit_hyper_start: int = 0
    fit_hyper_end: int = 0
    bootstrapping_number: int = 0


def _value(kind: object, text: str) -> object:
    items = [x.strip().strip("'\"") for x in text.strip().strip("[]").split(",") if x.strip()]
    if str(kind).startswith("tuple[int"):
        return tuple(map(int, items))
    if str(kind).startswith("tuple"):
        return tuple(items)
    return int(text) if kind in (int, "int") else text.strip().strip("'\"")


def parsed(text: str) -> dict[str, str]:
    """Dotted keys of a small YAML text with nested maps and plain or bracketed values."""
    out: dict[str, str] = {}
    above: list[tuple[int, str]] = []
    for line in text.splitlines():
        body = line.split("#")[0].rstrip()
        if not body.strip() or body.strip() == "---":
            continue
        depth = len(body) - len(body.lstrip())
        while above and above[-1][0] >= depth:
            above.pop()
        if body.lstrip().startswith("- "):
            key = ".".join(k for _, k in above)
            out[key] = f"{out[key]}, {body.lstrip()[2:]}" if key in out else body.lstrip()[2:]
            continue
        key, _, value = body.strip().partition(":")
        if value.strip():
            out[".".join([*(k for _, k in above), key])] = value.strip()
        else:
            above.append((depth, key))
    return out


def settings(text: str = "", environment: dict[str, str] | None = None, **explicit: object) -> Settings:
    """Settings from a YAML text; LOCIWAVE_COV_MAXL and the like override it, keyword arguments override both."""
    environment = dict(os.environ) if environment is None else environment
    known = {f.name: f.type for f in fields(Settings)}
    found = {k.replace(".", "_"): v for k, v in parsed(text).items()}
    found |= {k[9:].lower(): v for k, v in environment.items() if k.startswith("LOCIWAVE_")}
    return replace(Settings(), **{k: _value(known[k], v) for k, v in found.items() if k in known} | explicit)
