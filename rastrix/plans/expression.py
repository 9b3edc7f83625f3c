"""JSON requests compiled to DataFrames.

A request maps ids to nodes; a node calls a function with named arguments that are constants, arrays, references to other nodes, or
references to the parameter of an enclosing function that is mapped over a collection. Arguments are bound by the requests' own
names, in whatever order they stand; an unknown or missing name is an error. Shared nodes are built once. A collection is a table of cells
with an instant, and a function mapped over it works on all its coverages at once. `map.spatialRange` cuts the sources to the cells that meet
it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage as ops
from ..operators import feature, terrain
from . import catalogue


@dataclass(frozen=True)
class Function:
    """A function of requests: what to call, the arguments it must and may have, and other names for them."""

    call: Callable
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    other: dict[str, str] = field(default_factory=dict)

    def bound(self, name: str, given: dict) -> dict:
        found = {}
        for key, value in given.items():
            key = key if key in self.needs or key in self.may else self.other.get(key, key)
            if key not in self.needs and key not in self.may:
                raise ValueError(f"{name} has no argument {key}: {', '.join(self.needs + self.may)}")
            if key in found:
                raise ValueError(f"{name} gets {key} twice")
            found[key] = value
        if missing := [x for x in self.needs if x not in found]:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        return found


@dataclass(frozen=True)
class Place:
    """Where cells lie: cell (0, 0) begins at x0, y0; cells are `size` wide, and high; rows go up with y unless `down`."""

    x0: float
    y0: float
    size: float
    down: bool = False

    def within(self, cells: DataFrame, box: list[float]) -> DataFrame:
        """The cells that meet a box (x0, y0, x1, y1)."""
        left = self.x0 + F.col("px") * self.size
        low = self.y0 - (F.col("py") + 1) * self.size if self.down else self.y0 + F.col("py") * self.size
        return cells.where((left < box[2]) & (left + self.size > box[0]) & (low < box[3]) & (low + self.size > box[1]))


def _names(value) -> list[str]:
    """A list of names, or the text of one in brackets."""
    return [x.strip().strip('"') for x in value.strip().removeprefix("[").removesuffix("]").split(",")] if isinstance(value, str) else list(value)


_ONE, _TWO, _ALL = {"a": "coverage", "input": "coverage"}, {"a": "coverage1", "b": "coverage2"}, {"a": "coverageCollection", "input": "coverageCollection", "collection": "coverageCollection"}
_STYLE = ("bands", "gain", "bias", "min", "max", "gamma", "opacity", "palette", "format")

FUNCTIONS: dict[str, Function] = {
    **{f"Coverage.{op}": Function((lambda op: lambda coverage1, coverage2: ops.paired(coverage1, coverage2, op))(op), ("coverage1", "coverage2"), other=_TWO) for op in ops.BINARY},
    **{f"Coverage.{op}": Function((lambda op: lambda coverage: ops.unary(coverage, op))(op), ("coverage",), other=_ONE) for op in ops.UNARY},
    **{f"Coverage.{op}": Function((lambda op: lambda coverage: ops.cast(coverage, op))(op), ("coverage",), other=_ONE) for op in ops.CASTS},
    **{f"CoverageCollection.{op}": Function((lambda op: lambda coverageCollection: ops.mosaic(coverageCollection, op))(op), ("coverageCollection",), other=_ALL) for op in ops.REDUCERS},
    "CoverageCollection.mosaic": Function(lambda coverageCollection: ops.mosaic(coverageCollection, "mean"), ("coverageCollection",), other=_ALL),
    "Coverage.selectBands": Function(lambda coverage, bands: ops.select_bands(coverage, _names(bands)), ("coverage", "bands"), other=_ONE),
    "Coverage.binarization": Function(lambda coverage, threshold: ops.binarization(coverage, float(threshold)), ("coverage", "threshold"), other=_ONE),
    "Coverage.normalizedDifference": Function(lambda coverage, bandNames: ops.normalized_difference(coverage, *_names(bandNames)), ("coverage", "bandNames"), other=_ONE | {"names": "bandNames"}),
    "Coverage.clamp": Function(lambda coverage, low, high: ops.clamp(coverage, float(low), float(high)), ("coverage", "low", "high"), other=_ONE),
    **{f"Coverage.focal{op.capitalize()}": Function((lambda op: lambda coverage, radius=1, kernelType="square": ops.focal(coverage, op, int(radius)))(op), ("coverage",), ("radius", "kernelType"), _ONE) for op in ("mean", "median", "min", "max", "mode")},
    "Coverage.convolve": Function(lambda coverage, kernel: ops.convolve(coverage, kernel), ("coverage", "kernel"), other=_ONE),
    **{f"Kernel.{k}": Function((lambda k: lambda axis: ops.KERNELS[f"{k}_{axis}"])(k), ("axis",)) for k in ("sobel", "prewitt", "kirsch")},
    **{f"Kernel.{k}": Function((lambda k: lambda: ops.KERNELS[k])(k), ()) for k in ("laplacian4", "laplacian8")},
    "Kernel.fixed": Function(lambda weights: ops.fixed_kernel(json.loads(weights) if isinstance(weights, str) else weights), ("weights",)),
    "Kernel.square": Function(lambda radius, value=1.0, normalize=False: ops.square_kernel(int(radius), float(value), str(normalize).lower() == "true"), ("radius",), ("value", "normalize")),
    "Kernel.add": Function(lambda kernel1, kernel2: ops.add_kernels(kernel1, kernel2), ("kernel1", "kernel2")),
    "Terrain.slope": Function(lambda coverage, radius=1, **z: ops.slope(ops.scaled(coverage, float(z.get("z-Factor", 1)))), ("coverage",), ("radius", "z-Factor"), _ONE),
    "Terrain.aspect": Function(lambda coverage, radius=1: terrain.aspect(coverage), ("coverage",), ("radius",), _ONE),
    # styles say how a result is drawn; its values stay
    "Coverage.addStyles": Function(lambda coverage, **_: coverage, ("coverage",), _STYLE, _ONE),
    "CoverageCollection.addStyles": Function(lambda coverageCollection, **_: coverageCollection, ("coverageCollection",), _STYLE, _ALL),
    "Cube.addStyles": Function(lambda cube, **_: cube, ("cube",), _STYLE, {"a": "cube", "input": "cube"}),
    **{f"Filter.{op}": Function((lambda op: lambda leftField, rightValue: {op: [leftField, rightValue]})(op), ("leftField", "rightValue")) for op in catalogue.COMPARISONS},
    **{f"Filter.{op}": Function((lambda op: lambda filters: {op: filters})(op), ("filters",)) for op in ("and", "or")},
    "Filter.not": Function(lambda filter: {"not": filter}, ("filter",)),
    "CoverageCollection.filter": Function(lambda collection, filter: catalogue.filtered(collection, filter), ("collection", "filter")),
    "Collection.map": Function(lambda collection, baseAlgorithm: baseAlgorithm(collection), ("collection", "baseAlgorithm"), other={"c": "collection", "f": "baseAlgorithm"}),
    **{f"Feature.{name}": Function((lambda f: lambda featureRDD, crs=None: featureRDD.withColumn(f.__name__, f(F.col("ring"))))(getattr(feature, name)), ("featureRDD",), ("crs",)) for name in ("area", "bounds", "centroid", "length")},
}
FUNCTIONS["CoverageCollection.map"] = FUNCTIONS["Collection.map"]

#: Sources: the argument that names a table, and the others they may have.
SOURCES = {
    "Service.getCoverage": ("coverageID", ("productID", "baseUrl"), {"id": "coverageID"}),
    "Service.getCoverageCollection": ("productID", ("datetime", "bbox", "baseUrl"), {"id": "productID"}),
    "Service.getCube": ("cubeID", ("products", "bands", "time", "extent", "tms", "resolution", "baseUrl"), {"id": "cubeID"}),
    "Service.getFeature": ("productId", ("productID", "datetime", "bbox", "crs", "baseUrl"), {"id": "productId"}),
    "Feature.load": ("productName", ("dateTime", "crs"), {"id": "productName"}),
}


def _chosen(table: DataFrame, datetime=None, bbox=None, **_) -> DataFrame:
    """The rows of a catalogue (time, x0, y0, x1, y1) or of cells (instant) that a source's span of time and box choose; a table without such columns stays."""
    if datetime and "time" in table.columns:
        table = catalogue.filtered(table, {"date": ["time", *_names(datetime)]})
    elif datetime and dict(table.dtypes).get("instant") in ("date", "timestamp"):
        table = table.where(F.col("instant").between(*(F.lit(x).cast("timestamp") for x in _names(datetime))))
    if bbox and {"x0", "y0", "x1", "y1"} <= set(table.columns):
        table = catalogue.filtered(table, {"bounds": [float(x) for x in _names(bbox)] if isinstance(bbox, str) else bbox})
    return table


def compile_graph(text: str, sources: dict[str, DataFrame], root: str = "0", functions: dict[str, Function] | None = None, place: Place | None = None) -> DataFrame:
    """The DataFrame of the request's root; sources are the tables that its services name. Cycles, unknown functions and wrong arguments are errors. With `place`, sources of cells are cut to the request's spatial range."""
    graph, known = json.loads(text), FUNCTIONS | (functions or {})
    built: dict[str, object] = {}
    open_nodes: set[str] = set()
    seen = (graph.get("map") or {}).get("spatialRange")

    def source(name: str, given: dict) -> DataFrame:
        key, may, other = SOURCES[name]
        args = Function(dict, (key,), may, other).bound(name, given)
        if args[key] not in sources:
            raise ValueError(f"unknown source {args[key]}")
        table = _chosen(sources[args[key]], args.get("datetime"), args.get("bbox"))
        return place.within(table, seen) if place and seen and {"px", "py"} <= set(table.columns) else table

    def value(node, bound):
        if "constantValue" in node:
            return node["constantValue"]
        if "arrayValue" in node:
            return [value(v, bound) for v in node["arrayValue"]["values"]]
        if "argumentReference" in node:
            return bound[node["argumentReference"]]
        if "valueReference" in node:
            ref = node["valueReference"]
            if ref not in graph:
                raise ValueError(f"no node {ref}")
            if bound:
                return value(graph[ref], bound)
            if ref in open_nodes:
                raise ValueError(f"node {ref} refers to itself")
            if ref not in built:
                open_nodes.add(ref)
                built[ref] = value(graph[ref], bound)
                open_nodes.discard(ref)
            return built[ref]
        if "functionDefinitionValue" in node:
            made = node["functionDefinitionValue"]
            return lambda *args: value(graph[made["body"]], bound | dict(zip(made["argumentNames"], args, strict=True)))
        call = node["functionInvocationValue"]
        name = call["functionName"]
        if name not in known and name not in SOURCES:
            raise ValueError(f"unknown function {name}")
        given = {k: value(v, bound) for k, v in call["arguments"].items()}
        return source(name, given) if name in SOURCES else known[name].call(**known[name].bound(name, given))

    return value({"valueReference": root}, {})
