"""Command lines: prepare a stack, list pairs, run the chain, export points, compare tables, write parameters.

    python -m siltgrid.cli prepare STACK OUT --mode ps
    python -m siltgrid.cli pairs STACK --neighbours 2
    python -m siltgrid.cli run OUT --start weed --end scn
    python -m siltgrid.cli export OUT points.gpkg --corrections v-dso
    python -m siltgrid.cli compare A.parquet B.parquet --keys pid --phases ph
    python -m siltgrid.cli parameters parms.json --small-baseline
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from siltgrid.operators import validation
from siltgrid.params import Params, prepare_modes
from siltgrid.plans import pipeline, prepare
from siltgrid.session import local_session
from siltgrid.sources import metadata, vectors


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltgrid", description="stacks of images from rasters to displacement")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("prepare", help="rasters to the first table of the chain")
    c.add_argument("stack")
    c.add_argument("out")
    c.add_argument("--layout", choices=("single", "merged"))
    c.add_argument("--mode", default="auto", help="ps, sb, both (ps,sb) or auto")
    c.add_argument("--threshold", type=float, help="amplitude dispersion, by default 0.4 and of pairs 0.6")
    c.add_argument("--patches", type=int, nargs=2, default=(1, 1), metavar=("RANGE", "AZIMUTH"))
    c.add_argument("--overlap", type=int, default=50)
    c.add_argument("--reference", type=int)
    c.add_argument("--heading", type=float)
    c.add_argument("--wavelength", type=float)
    c.add_argument("--pairs", help="text file of date pairs")
    c.add_argument("--text", action="store_true", help="write the text products too")
    c = sub.add_parser("pairs", help="pairs of a stack, one a line")
    c.add_argument("stack")
    c.add_argument("--source", choices=("auto", "ifg", "list", "consecutive"), default="auto")
    c.add_argument("--list", help="text file of date pairs")
    c.add_argument("--neighbours", type=int, default=1)
    c = sub.add_parser("run", help="steps of the chain; goes on after what is done")
    c.add_argument("folder")
    c.add_argument("--start", choices=pipeline.STEPS)
    c.add_argument("--end", choices=pipeline.STEPS, default="export")
    c.add_argument("--corrections", choices=pipeline.MODES, default="v-dso")
    c.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    c = sub.add_parser("export", help="exported points to a file")
    c.add_argument("folder")
    c.add_argument("target", help=".gpkg, .shp, .geojson, .csv or .parquet")
    c.add_argument("--corrections", choices=pipeline.MODES)
    c.add_argument("--max-points", type=int, help="the first points by id only, to look at")
    c = sub.add_parser("compare", help="two tables field by field, as JSON")
    c.add_argument("left")
    c.add_argument("right")
    c.add_argument("--keys", nargs="+", default=["pid"])
    c.add_argument("--phases", nargs="*", default=[])
    c.add_argument("--alias", action="append", default=[], metavar="LEFT=RIGHT")
    c.add_argument("--sample", type=int)
    c = sub.add_parser("parameters", help="a parameter file with all defaults")
    c.add_argument("path")
    c.add_argument("--small-baseline", action="store_true")
    return p


def chosen_pairs(files: prepare.StackFiles, source: str, listed: str | None, neighbours: int) -> list[tuple[int, int]]:
    """Pairs of dates: from a list, from the interferograms, or each date with the next ones; auto takes the first of these there is."""
    if source == "auto":
        source = "list" if listed else "ifg" if any(isinstance(k, tuple) for k in files.interferograms) else "consecutive"
    if source == "list":
        if not listed:
            raise ValueError("pairs from a list need --list")
        pairs = metadata.pair_list(listed)
    elif source == "ifg":
        pairs = sorted(k for k in files.interferograms if isinstance(k, tuple))
    else:
        d = files.dates
        pairs = [(d[i], d[j]) for i in range(len(d)) for j in range(i + 1, min(len(d), i + 1 + neighbours))]
    unknown = sorted({d for p in pairs for d in p} - set(files.images))
    if unknown:
        raise ValueError(f"pairs of dates without an image: {', '.join(map(str, unknown))}")
    return pairs


def _files(a) -> prepare.StackFiles:
    layout = getattr(a, "layout", None) or ("merged" if (Path(a.stack) / "merged").is_dir() else "single")
    if layout == "merged":
        return prepare.merged_layout(a.stack, getattr(a, "reference", None), getattr(a, "heading", None) or 0.0, getattr(a, "wavelength", None) or 0.056)
    files = prepare.single_reference_layout(a.stack)
    for name in ("heading", "wavelength"):
        if getattr(a, name, None) is not None:
            setattr(files, name, getattr(a, name))
    return files


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def _axis(folder: str) -> pipeline.Images:
    held = json.loads((Path(folder) / "images.json").read_text())
    return pipeline.Images(**{**held, "pairs": [tuple(p) for p in held["pairs"]]})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "parameters":
        Params(small_baseline=a.small_baseline).add("small_baseline_flag", "y" if a.small_baseline else "n").write(a.path)
        return 0
    if a.command == "pairs":
        print("".join(f"{i} {j}\n" for i, j in chosen_pairs(_files(a), a.source, a.list, a.neighbours)), end="")
        return 0
    spark = spark or local_session("siltgrid-cli")
    if a.command == "prepare":
        files = _files(a)
        has_pairs = any(isinstance(k, tuple) for k in files.interferograms) or bool(a.pairs)
        modes = prepare_modes(a.mode, has_pairs, any(isinstance(k, int) for k in files.interferograms))
        for mode in modes:
            out = Path(a.out) / mode if len(modes) > 1 else Path(a.out)
            out.mkdir(parents=True, exist_ok=True)
            pairs = chosen_pairs(files, "auto", a.pairs, 1) if mode == "sb" else None
            table, images = prepare.prepare(spark, files, mode, a.threshold if a.threshold is not None else 0.6 if mode == "sb" else 0.4, pairs, tuple(a.patches), a.overlap)
            vectors.write_stage(table, f"{out}/prepared", "patch")
            (out / "images.json").write_text(json.dumps(vars(images)))
            Params(small_baseline=mode == "sb").add("small_baseline_flag", "y" if mode == "sb" else "n").write(out / "parms.json")
            if a.text:
                prepare.write_text_products(out / "text", files, table, None, pairs)
            print(f"{mode}: {table.select('pid').distinct().count()} candidates")
    elif a.command == "run":
        params = Params.load(a.folder)
        for item in a.set:
            name, _, value = item.partition("=")
            params = params.set(name, _value(value), local=True)
        points = spark.read.parquet(f"{a.folder}/prepared")
        done = pipeline.run(points, _axis(a.folder), params, a.start, a.end, None, f"{Path(a.folder).resolve()}/steps", a.corrections)
        print(", ".join(s for s in pipeline.STEPS if s in done))
    elif a.command == "export":
        steps = f"{Path(a.folder).resolve()}/steps"
        stages = pipeline.Stages(spark, steps)
        if a.corrections:
            params = Params.load(a.folder)
            images = _axis(a.folder)
            table = pipeline.export_points(pipeline.referenced(stages.read("scn"), params, len(images.day)), images, a.corrections, stages.get("covariance"))
        else:
            table = stages.read("export")
        if a.max_points:
            table = table.orderBy("pid").limit(a.max_points)
        kind = Path(a.target).suffix
        writers = {".gpkg": vectors.write_geopackage, ".shp": vectors.write_shapefile, ".geojson": vectors.write_geojson, ".csv": vectors.write_csv, ".parquet": lambda df, path: vectors.write_stage(vectors.with_wkb(df), path)}
        if kind not in writers:
            raise ValueError(f"{a.target}: {', '.join(writers)}")
        writers[kind](table, a.target)
    else:
        aliases = dict(x.split("=", 1) for x in a.alias)
        found = validation.report(spark.read.parquet(a.left), spark.read.parquet(a.right), a.keys, aliases, tuple(a.phases), a.sample)
        print(json.dumps(found, indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
