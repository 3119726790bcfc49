"""Text metadata of a stack: vectors, key-value files, baselines, calibration lists, dates in paths."""

from __future__ import annotations

import re
from pathlib import Path

_DATE = re.compile(r"(?<!\d)((?:19|20)\d{6})(?!\d)")
_PAIR = re.compile(r"(?<!\d)((?:19|20)\d{6})[_-]((?:19|20)\d{6})(?!\d)")


def find(folder: str | Path, name: str, levels: int = 1) -> Path | None:
    """A file in a folder or up to `levels` of its parents."""
    here = Path(folder)
    for place in [here, *list(here.resolve().parents)[:levels]]:
        if (place / name).is_file():
            return place / name
    return None


def vector(path: str | Path) -> list[float]:
    """All numbers of a text file."""
    return [float(x) for x in Path(path).read_text().split()]


def key_values(*paths: str | Path) -> dict[str, str]:
    """name value lines; '#' starts a comment, later files win."""
    out: dict[str, str] = {}
    for path in paths:
        for line in Path(path).read_text(errors="ignore").splitlines():
            parts = line.split("#")[0].strip().split(None, 1)
            if len(parts) == 2:
                out[parts[0].lower()] = parts[1].strip()
    return out


def average_baseline(path: str | Path) -> float | None:
    """The average perpendicular baseline of a report."""
    m = re.search(r"Bperp\s*\(average\)\s*:\s*([-+.\deE]+)", Path(path).read_text(errors="ignore"))
    return float(m[1]) if m else None


def baseline_overview(path: str | Path, reference: int, dates: list[int]) -> list[float] | None:
    """Baselines of dates relative to the reference from date-value lines; the reference's own where a date is missing."""
    found: dict[int, float] = {}
    for line in Path(path).read_text(errors="ignore").splitlines():
        p = line.split()
        if len(p) >= 2 and _DATE.fullmatch(p[0]):
            try:
                found[int(p[0])] = float(p[1])
            except ValueError:
                pass
    if not found:
        return None
    base = found.get(reference, 0.0)
    return [found.get(d, base) - base for d in dates]


def path_date(path: str) -> int | None:
    """Last date in a path."""
    m = _DATE.findall(path)
    return int(m[-1]) if m else None


def path_pair(path: str | Path) -> tuple[int, int] | None:
    """Pair of dates from a file's or its folder's name."""
    p = Path(path)
    for part in (p.stem, p.name, p.parent.name):
        if m := _PAIR.search(part):
            return int(m[1]), int(m[2])
    return None


def by_date(paths: list[str]) -> dict[int, str]:
    """Path of each date; two paths of one date are an error."""
    out: dict[int, str] = {}
    for p in paths:
        d = path_date(p)
        if d is None:
            continue
        if d in out:
            raise ValueError(f"two images of {d}: {out[d]} and {p}")
        out[d] = p
    return out


#: Image suffixes, the preferred first.
IMAGE_SUFFIXES = (".slc.full", ".vrt", ".slc", ".slc.vrt")


def discover_images(folder: str | Path) -> dict[int, str]:
    """Image of each date below a folder: the preferred suffix, then the larger file."""
    best: dict[int, tuple] = {}
    for place in sorted(Path(folder).glob("*")):
        if not place.is_dir() or not _DATE.fullmatch(place.name):
            continue
        for rank, suffix in enumerate(IMAGE_SUFFIXES):
            for f in place.glob(f"*{suffix}"):
                if suffix in (".vrt", ".slc.vrt") and not f.name.endswith(suffix):
                    continue
                key = (rank, -f.stat().st_size, str(f))
                if int(place.name) not in best or key < best[int(place.name)]:
                    best[int(place.name)] = key
    return {d: k[2] for d, k in best.items()}


def discover_pairs(folders: list[str | Path], patterns: str = "**/filt_*.int,**/*.int") -> dict[tuple[int, int], str]:
    """Interferogram of each pair; the first pattern that finds one wins."""
    out: dict[tuple[int, int], str] = {}
    for pattern in (p.strip() for p in patterns.split(",") if p.strip()):
        for folder in folders:
            for f in sorted(Path(folder).glob(pattern)):
                pair = path_pair(f)
                if pair and pair not in out:
                    out[pair] = str(f)
    return out


def pair_list(path: str | Path) -> list[tuple[int, int]]:
    """Pairs of a text file, separated by blanks or commas; '#' starts a comment."""
    out = []
    for line in Path(path).read_text().splitlines():
        p = line.split("#")[0].replace(",", " ").split()
        if len(p) >= 2:
            out.append((int(p[0]), int(p[1])))
    return out


def calibration_list(path: str | Path, reference: int) -> list[tuple[int, float]]:
    """(date, constant) of a calibration file without the reference, by date."""
    out = []
    for line in Path(path).read_text().splitlines():
        p = line.split()
        if len(p) >= 2 and (d := path_date(" ".join(p[:-1]))) and d != reference:
            out.append((d, float(p[-1])))
    return sorted(out)


def patch_folders(project: str | Path) -> list[Path]:
    """Patches of a project: its patch list, else PATCH_ folders, else the project itself."""
    here = Path(project)
    if (here / "patch.list").is_file():
        return [here / x for x in (here / "patch.list").read_text().split()]
    return sorted(here.glob("PATCH_*"), key=lambda p: int(p.name.split("_")[-1])) or [here]


def nearest_shape(n: int, width: int, length: int) -> tuple[int, int]:
    """(rows, columns) of n samples: the full raster, else the factors closest to its aspect."""
    if n == width * length:
        return length, width
    aspect = length / width
    pairs = [(r, n // r) for r in range(1, int(n**0.5) + 1) if n % r == 0]
    pairs += [(c, r) for r, c in pairs]
    return min(pairs, key=lambda p: abs(p[0] / p[1] - aspect))


def reference_date(values: dict[str, str], folders: list[str]) -> int | None:
    """Reference date: from key-values, else the date most baseline folders begin with."""
    for key in ("reference", "reference_date", "master", "master_date"):
        if key in values and (d := path_date(values[key])):
            return d
    from collections import Counter

    first = Counter(p[0] for f in folders if (p := path_pair(f)))
    return first.most_common(1)[0][0] if first else None
