"""Column expressions for names, paths, hashes and parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that count as images (fixed values).
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path: Column | str) -> Column:
    """What follows the last dot, lower-cased; null without a dot."""
    return F.when(_col(path).contains("."), F.lower(F.element_at(F.split(_col(path), r"\."), -1)))


def is_image(path: Column | str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    return F.coalesce(extension(path).isin(*extensions), F.lit(False))


def clean_path(path: Column | str) -> Column:
    """Repeated slashes and ``/./`` made one slash, the one at the end dropped."""
    once = F.regexp_replace(_col(path), r"/+(\./+)*", "/")
    return F.when(F.length(once) > 1, F.regexp_replace(once, "/$", "")).otherwise(once)


def joined_url(base: str, path: Column | str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(_col(path), "^/+", ""))


def clean_space(s: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(s), r"\s+", " "))


def category_text(name: Column | str) -> Column:
    """A category name as words: ``noun (adjective)`` turned round, ``/`` read as ``or``, ``_`` and ``-`` as spaces."""
    turned = F.regexp_replace(_col(name), r"^\s*([^()]+?)[\s_]*\(([^()]*)\)\s*$", "$2 $1")
    return clean_space(F.regexp_replace(F.regexp_replace(turned, "/", " or "), r"[_\-()]", " "))


# How categories of some datasets are asked for, whatever the rules say.
SPECIAL_QUERIES = {
    "bdd": {
        "motor": "motorcycle", "rider": "bike rider", "gas stations scene": "gas station", "trailer": "trailer hitched to a car", "highway scene": "highway",
        "parking lot scene": "parking lot", "city street scene": "city street", "residential scene": "residential street", "tunnel scene": "tunnel",
        "overcast weather": "overcast sky", "partly cloudy weather": "partly cloudy sky", "clear weather": "clear skies", "foggy weather": "foggy weather", "wheelchair": "wheelchair",
    },
    "coco": {"mouse": "computer mouse"},
}


def dataset_query(dataset: Column | str, category: Column | str) -> Column:
    """How a category is asked for in its dataset: a fixed query where there is one; else by the dataset's rule.

    objectnet: one ``noun (adjective)`` turned round, ``/`` read as ``or``; lvis and lvispatch: ``_`` and brackets as spaces; dota: ``-`` as
    spaces; any other: the name as it is.
    """
    of, name = _col(dataset), _col(category)
    parts = F.split(name, r"\(", -1)
    turned = F.when(F.size(parts) == 2, F.concat_ws(" ", F.regexp_replace(parts[1], r"\)", " "), parts[0])).otherwise(name)
    rule = (
        F.when(of == "objectnet", clean_space(F.regexp_replace(turned, "/", " or "))).when(of.isin("lvis", "lvispatch"), clean_space(F.regexp_replace(name, "[_()]", " ")))
        .when(of == "dota", F.regexp_replace(name, "-", " ")).otherwise(name)
    )
    fixed = F.create_map(*[F.lit(v) for d, by in SPECIAL_QUERIES.items() for c, q in by.items() for v in (f"{d}\0{c}", q)])
    return F.coalesce(fixed[F.concat(of, F.lit("\0"), name)], rule)


def query_text(name: Column | str, template: str = "a {}") -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), category_text(name), F.lit(after))


def user_hash(s: Column | str, digits: int = 10) -> Column:
    return F.substring(F.md5(_col(s).cast("binary")), 1, digits)


def local_time(epoch_seconds: Column | str, zone: str = "US/Eastern") -> Column:
    """Epoch seconds, rounded to milliseconds, as wall time of ``zone``."""
    return F.from_utc_timestamp(F.timestamp_millis(F.round(_col(epoch_seconds) * 1000).cast("long")), zone)


def canonical_hash(parameters: str | None, dropped: tuple[str, ...] = ("index_spec",), dropped_if_null: tuple[str, ...] = ("annotation_category",)) -> str | None:
    """Eight hexadecimal digits that tell parameter sets apart, whatever the order of their keys."""
    if parameters is None:
        return None
    try:
        values = json.loads(parameters)
    except ValueError:
        return None
    if isinstance(values, dict):
        values = {k: v for k, v in values.items() if k not in dropped and not (k in dropped_if_null and v is None)}
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()[:8]


def parameter_hash(parameters: Column | str) -> Column:
    @F.pandas_udf("string")
    def hashed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(canonical_hash, na_action="ignore")

    return hashed(_col(parameters))


def parameter(parameters: Column | str, path: str, kind: str = "double", only: Column | None = None) -> Column:
    """A value inside a JSON document, or null; where ``only`` is given, null wherever it doesn't hold."""
    value = F.get_json_object(_col(parameters), f"$.{path}").try_cast(kind)
    return value if only is None else F.when(only, value)
