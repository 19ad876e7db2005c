"""Settings: typed values from the environment (case does not matter, unknown names are ignored)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    # The defaults.
    report_threshold: float = 0.5
    critical_threshold: float = 0.3
    magnitude_gap: float = 0.3
    reader_b_mode: str = "reader"
    kappa_floor: float = 0.4
    disagreement_ceiling: float = 0.4
    max_judgments: int = 12
    max_findings: int = 50
    symmetry_threshold: float = 0.5
    use_live_models: bool = False
    corpus_root: str = "data/corpus"

    @classmethod
    def from_file(cls, path: str, env: dict[str, str] | None = None) -> Settings:
        """Settings of a file of NAME=value lines (# comments, quotes and an export before the name allowed); the environment wins."""
        given = {}
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, found, value = line.strip().removeprefix("export ").partition("=")
                if found and not name.startswith("#"):
                    given[name.strip()] = value.strip().strip("\"'")
        return cls.from_env({k.lower(): v for k, v in given.items()} | {k.lower(): v for k, v in (os.environ if env is None else env).items()})

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        given = {k.lower(): v for k, v in (os.environ if env is None else env).items()}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        read = {bool: lambda v: v.strip().lower() in ("1", "true", "yes", "on")}
        out = cls(**{k: read.get(kind, kind)(given[k]) for k, kind in kinds.items() if k in given})
        if out.reader_b_mode not in ("reader", "describer"):
            raise ValueError(f"unknown reader_b_mode {out.reader_b_mode!r}")
        return out


#: Fixed value: studies beyond which a run that costs money must be asked for.
UNATTENDED = 100


def check_run_size(studies: int, keyed: bool, confirmed: bool = False) -> None:
    """Raises where a run with paid model calls is larger than nobody should start by accident."""
    if keyed and studies > UNATTENDED and not confirmed:
        raise ValueError(f"{studies} studies with a live model: more than {UNATTENDED} need a confirmation")
