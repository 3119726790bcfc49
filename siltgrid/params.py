"""Parameters of a stack run: defaults, three levels of precedence, lookup by unambiguous prefix."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: What a parameter is if nobody sets it.
DEFAULTS: dict[str, Any] = {
    "max_topo_err": 20.0,
    "quick_est_gamma_flag": "y",
    "select_reest_gamma_flag": "y",
    "slc_osf": 1.0,
    "filter_grid_size": 50.0,
    "filter_weighting": "P-square",
    "gamma_change_convergence": 0.005,
    "gamma_max_iterations": 3.0,
    "clap_win": 32.0,
    "clap_low_pass_wavelength": 800.0,
    "clap_alpha": 1.0,
    "clap_beta": 0.3,
    "select_method": "DENSITY",
    "gamma_stdev_reject": 0.0,
    "weed_time_win": 730.0,
    "weed_max_noise": math.inf,
    "weed_zero_elevation": "n",
    "weed_neighbours": "n",
    "unwrap_patch_phase": "n",
    "drop_ifg_index": [],
    "unwrap_la_error_flag": "y",
    "unwrap_prefilter_flag": "y",
    "unwrap_grid_size": 200.0,
    "unwrap_gold_n_win": 32.0,
    "unwrap_alpha": 8.0,
    "unwrap_time_win": 730.0,
    "unwrap_gold_alpha": 0.8,
    "scla_drop_index": [],
    "scn_wavelength": 100.0,
    "scn_time_win": 365.0,
    "scn_deramp_ifg": [],
    "ref_lon": [-math.inf, math.inf],
    "ref_lat": [-math.inf, math.inf],
    "ref_centre_lonlat": [0.0, 0.0],
    "ref_radius": math.inf,
    "merge_standard_dev": math.inf,
    "scla_method": "L2",
    "scla_deramp": "n",
    "subtr_tropo": "n",
    "tropo_method": "a_l",
}
#: Defaults of a pair network, and of a single reference.
BY_MODE: dict[str, tuple[Any, Any]] = {
    "density_rand": (2.0, 20.0),
    "percent_rand": (1.0, 20.0),
    "weed_standard_dev": (math.inf, 1.0),
    "unwrap_method": ("3D_QUICK", "3D"),
    "merge_resample_size": (100.0, 0.0),
}
#: Parameters that name what there is one way for: the quick estimate, and a weight of the low-pass that no step uses.
ONLY = {"quick_est_gamma_flag": "y", "unwrap_alpha": 8.0}
_SPELT = {"inf": math.inf, "-inf": -math.inf, "nan": math.nan}


def _read(value: Any) -> Any:
    if isinstance(value, list):
        return [_read(v) for v in value]
    return _SPELT.get(value.lower(), value) if isinstance(value, str) else value


def _spell(value: Any) -> Any:
    if isinstance(value, (list, tuple)):
        return [_spell(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return "nan" if math.isnan(value) else "inf" if value > 0 else "-inf"
    return value


def read_json(path: str | Path) -> dict[str, Any]:
    """A parameter file; infinities and NaN are spelt as strings. A missing file holds nothing."""
    p = Path(path)
    return {k: _read(v) for k, v in json.loads(p.read_text()).items()} if p.is_file() else {}


def read_file(stem: Path) -> dict[str, Any]:
    """Parameters of stem.json, else of stem.mat, else none."""
    if stem.with_suffix(".json").is_file() or not stem.with_suffix(".mat").is_file():
        return read_json(stem.with_suffix(".json"))
    from siltgrid.sources.matlab import parameters

    return {k: _read(v) for k, v in parameters(stem.with_suffix(".mat")).items()}


@dataclass(frozen=True)
class Params:
    """Values by name: local before base before default. Never changed in place."""

    base: dict[str, Any] = field(default_factory=dict)
    local: dict[str, Any] = field(default_factory=dict)
    small_baseline: bool = False

    @property
    def merged(self) -> dict[str, Any]:
        mode = {k: v[0 if self.small_baseline else 1] for k, v in BY_MODE.items()}
        return {**DEFAULTS, **mode, **self.base, **self.local}

    def name(self, prefix: str) -> str:
        """The exact name, or the only one that begins with prefix."""
        names = self.merged
        if prefix in names:
            return prefix
        found = sorted(n for n in names if n.startswith(prefix))
        if len(found) != 1:
            raise KeyError(f"{prefix}: " + ("no such parameter" if not found else "could be " + ", ".join(found)))
        return found[0]

    def get(self, prefix: str) -> Any:
        return self.merged[self.name(prefix)]

    def checked(self) -> Params:
        """These parameters, if all they ask for is done: those in ONLY have one way each."""
        for name, value in ONLY.items():
            if self.get(name) != value:
                raise ValueError(f"{name}: only {value!r} is done, not {self.get(name)!r}")
        return self

    def set(self, prefix: str, value: Any, local: bool = False) -> Params:
        """A copy with another value; NaN puts the default back."""
        name, level = self.name(prefix), "local" if local else "base"
        values = dict(getattr(self, level))
        if isinstance(value, float) and math.isnan(value):
            values.pop(name, None)
        else:
            values[name] = value
        return dataclasses.replace(self, **{level: values})

    def add(self, name: str, value: Any) -> Params:
        return dataclasses.replace(self, base={**self.base, name: value})

    def remove(self, name: str) -> Params:
        return dataclasses.replace(self, base={k: v for k, v in self.base.items() if k != name}, local={k: v for k, v in self.local.items() if k != name})

    @classmethod
    def load(cls, folder: str | Path) -> Params:
        """Base from the parent's and the folder's parms, local from the folder's localparms: .json, and .mat where there is none."""
        here = Path(folder)
        base = read_file(here.parent / "parms") | read_file(here / "parms")
        return cls(base, read_file(here / "localparms"), str(base.get("small_baseline_flag", "n")).lower() == "y")

    def write(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps({k: _spell(v) for k, v in self.merged.items()}, indent=1, sort_keys=True))


def image_list(raw: Any, n: int) -> list[int]:
    """0-based images of a drop list given 1-based as a number, a list or a text; numbers out of range are left out."""
    if raw is None:
        return []
    if isinstance(raw, str):
        raw = raw.replace(",", " ").strip("[] ").split()
    items = raw if isinstance(raw, (list, tuple)) else [raw]
    return sorted({int(float(v)) - 1 for v in items if 1 <= float(v) <= n})


def deramp_list(raw: Any, used: list[int], n: int) -> list[int]:
    """Positions among the used images of those to deramp: 'all', or a 1-based list."""
    if isinstance(raw, str) and raw.strip().lower() == "all":
        return list(range(len(used)))
    wanted = set(image_list(raw, n))
    return [k for k, u in enumerate(used) if u in wanted]


def prepare_modes(text: str, has_pairs: bool, has_reference: bool) -> list[str]:
    """Views to prepare: 'ps', 'sb', both, or 'auto' by what the stack holds."""
    if text == "auto":
        return [m for m, there in (("ps", has_reference), ("sb", has_pairs)) if there] or ["ps"]
    modes = list(dict.fromkeys(m.strip() for m in text.split(",") if m.strip()))
    if not modes or set(modes) - {"ps", "sb"}:
        raise ValueError(f"mode {text!r}: ps, sb, ps,sb or auto")
    return modes
